"""SQL that says what some of the corpus queries return.

Tokens, XXH64 fingerprints, fitted models and page trees have no counterpart in SQL; their queries are held
against brute force in the tests.
"""

from __future__ import annotations

from .manifest import COLUMNS, FANOUT
from .maxscore import EVERY, SCALE, K
from .mixing import CHECKED, FRACTION, MARGINS, NEAR, ROUNDS, SEED, SYMBOLS, TOPICS
from .quality_rules import RULES, STOP_WORDS
from .resampling import BUCKETS, LEAST_WORDS, LOWER, ORDERS, PERCENT, UPPER
from .resampling import SCALE as RESAMPLING_SCALE
from .resampling import SEED as RESAMPLING_SEED

SPACE = r"[\x20\x09-\x0D]"


def quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v}))
    ratios = {
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "ellipsis_line_ratio": "n_ellipsis_lines / greatest(n_lines, 1)",
        "bullet_line_ratio": "n_bullet_lines / greatest(n_lines, 1)",
    }
    tests = [f"{ratios[r.metric]} {sign} {bound!r}" for r in RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
  w as (select *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
  g as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
  c as (select r, count(distinct i + k) as n_repeat_words from g, (select unnest([0, 1, 2]) as k) where n > 1 group by r),
  b as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, len(list_filter(w, lambda x: x in ({stops}))) as n_stop_words,
    len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, '…'))) as n_ellipsis_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) as n_bullet_lines from w left join c using (r)),
  f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed, not base_failed and {" and ".join(tests)} as kept from f"""


def search() -> str:
    return f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.r as asked, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score from v q join v c on q.vec_id % {EVERY} = 0 and c.r <> q.r),
  r as (select *, row_number() over (partition by asked order by score desc, vec_id) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""


def mixing() -> str:
    trimmed = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    count = lambda kept: f"length(regexp_replace(x, '{kept}', '', 'g'))"
    per = lambda n, times: f"cast(least(9, floor({times} * ({n}) / greatest(tokens, 1)::double)) as bigint)"
    letters, lines = f"length(x) - length(regexp_replace(x, '[^\\x20\\x09-\\x0D]+', '', 'g'))", "length(x) - length(replace(x, chr(10), ''))"
    scales = ["cast(least(9, floor(ln(1 + tokens))) as bigint)", per(letters, 1), per(count("[^A-Z]+"), 10), per(count("[^0-9]+"), 10), per(count(SYMBOLS), 10), per(lines, 10)]
    steps = [
        f"r as (select doc_id, source, lang, coalesce(text, '') as x, case when {trimmed} = '' then 0 else len(regexp_split_to_array({trimmed}, '{SPACE}+')) end as tokens from documents)",
        f"g0 as materialized (select doc_id, source, lang, tokens, [{', '.join(scales)}] as f, 0 as g from r)",
    ]
    for made in range(1, TOPICS):
        # The group and the scale with the largest sum of squares about their mean, split at that mean.
        steps.append(
            f"""b{made} as materialized (select g, j, n, s from (select g, j, count(*)::double as n, sum(f[j])::double as s, sum(f[j] * f[j])::double as q from g{made - 1}, (select unnest(range(1, 7)) as j) where tokens > 0 group by g, j)
    where q - s * s / n > 0 order by q - s * s / n desc, g, j limit 1)"""
        )
        steps.append(f"g{made} as materialized (select * replace (case when g = (select g from b{made}) and f[(select j from b{made})] * (select n from b{made}) > (select s from b{made}) then {made} else g end as g) from g{made - 1})")
    steps += [
        f"d as (select doc_id, source, lang, tokens, case when tokens = 0 then 'empty' else 'topic ' || g end as topic from g{TOPICS - 1})",
        "c as materialized (select source, lang, topic, sum(tokens)::double as tokens, sum(sum(tokens)) over ()::double as total from d where tokens > 0 group by 1, 2, 3)",
    ]
    for i, m in enumerate(MARGINS):
        given = f"case {m.column} {' '.join(f"when '{k}' then {v!r}" for k, v in m.weights.items())} end" if m.weights else "null::double"
        steps += [
            f"l{i} as (select {m.column} as k, sum(tokens) / any_value(total) as share, {given} as given, power(sum(tokens) / any_value(total), {m.power!r}) as own from c group by {m.column})",
            f"""t{i} as (select k, share / {FRACTION!r} as most, coalesce(given * (1 - coalesce(sum(own) filter (where given is null) over (), 0) / sum(own) over ()) / sum(given) over (), own / sum(own) over ()) as target from l{i})""",
            # Levels in the order in which they are whole; the scale is the first that the next levels can bear.
            f"w{i} as (select *, (1 - coalesce(sum(most) over (order by most / target, k rows between unbounded preceding and 1 preceding), 0)) / sum(target) over (order by most / target, k rows between current row and unbounded following) as scale from t{i})",
            f"m{i} as materialized (select k, least(most, target * coalesce((select scale from w{i} where scale * target <= most * (1 + 1e-12) order by most / target, k limit 1), 1.0)) as target from t{i})",
        ]
    joins = " ".join(f"join m{i} on c.{m.column} is not distinct from m{i}.k" for i, m in enumerate(MARGINS))
    steps.append(f"k0 as materialized (select c.*, {', '.join(f'm{i}.target as target{i}' for i in range(len(MARGINS)))}, tokens / total as weight, false as settled from c {joins})")
    for r in range(ROUNDS):
        last = f"k{r}"
        for i, m in enumerate(MARGINS):
            name = f"k{r}_{i}"
            steps.append(f"{name} as materialized (select * replace (case when settled then weight else least(tokens / total / {FRACTION!r}, coalesce(weight * target{i} / nullif(sum(weight) over (partition by {m.column}), 0), 0.0)) end as weight) from {last})")
            last = name
        off = ", ".join(f"coalesce(abs(sum(weight) over (partition by {m.column}) / nullif(target{i}, 0) - 1), 0)" for i, m in enumerate(MARGINS))
        if r % CHECKED == CHECKED - 1 or r == ROUNDS - 1:
            steps.append(f"k{r + 1} as materialized (select * exclude (off) replace (max(off) over () <= {NEAR!r} as settled) from (select *, greatest({off}) as off from {last}))")
        else:
            steps.append(f"k{r + 1} as (select * from {last})")
    steps.append(f"p as (select source, lang, topic, weight, least(1.0, weight * {FRACTION!r} * total / tokens) as probability from k{ROUNDS})")
    digest = f"cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) / 281474976710656.0"
    return (
        "with " + ",\n".join(steps) + f"""
select d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(weight, 0.0), 9) as weight, round(coalesce(probability, 1.0), 9) as probability, {digest} < coalesce(probability, 1.0) as sampled
from d left join p on d.source is not distinct from p.source and d.lang is not distinct from p.lang and d.topic = p.topic"""
    )


#: What eight shifts make of a byte, for CRC-32.
CRC_TABLE = """crc_table as materialized (select list(v order by i) as crc_of from (select i, list_reduce(list_prepend(i, range(8)::bigint[]), lambda c, k: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end)) as v from (select unnest(range(256)) as i)))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of an expression; crc_of is in scope."""
    coded = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({coded}), 2), lambda i: ('0x' || substr({coded}, i, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(crc_of[xor(c, b) % 256 + 1], c >> 8)))"


def resampling() -> str:
    runs = " union all ".join(f"select r, array_to_string(w[i : i + {n - 1}], ' ') as f from (select r, w, unnest(range(1, len(w) + 2 - {n})) as i from {{0}})" for n in range(1, ORDERS + 1))
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with {CRC_TABLE},
  d as materialized (select row_number() over () as r, doc_id, {words} as w from documents), e as (select row_number() over () as r, {words} as w from benchmark),
  df as materialized ({runs.format("d")}), ef as materialized ({runs.format("e")}),
  c as materialized (select f, {crc32("f")} % {BUCKETS} as b from (select f from df union select f from ef), crc_table),
  s as (select b, count(*) as n from df join c using (f) group by b), t as (select b, count(*) as n from ef join c using (f) group by b),
  g as materialized (select b, floor({RESAMPLING_SCALE} * ln((coalesce(t.n, 0) + 1)::double * (coalesce((select sum(n) from s), 0) + {BUCKETS})::double
    / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from t), 0) + {BUCKETS})::double)))::bigint as gain from (select unnest(range({BUCKETS})) as b) left join s using (b) left join t using (b)),
  w as (select r, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from df join c using (f) join g using (b) group by r),
  o as (select r, doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{RESAMPLING_SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h from d left join w using (r)),
  p as (select *, (weight + floor(-{RESAMPLING_SCALE} * ln(-ln((h + 0.5::double) / 4294967296.0::double))))::bigint as score, n_words >= {LEAST_WORDS} as entitled from o),
  k as (select *, row_number() over (partition by entitled order by score desc, doc_id nulls last, r) as place, {PERCENT} * (count(*) over (partition by entitled)) // 100 as drawn from p)
select doc_id, n_features, weight, score, case when entitled and place <= drawn then place end as rank from k"""


def merkle() -> str:
    told = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar)))::varchar || ':' || cast({c} as varchar), '-')"
    leaf = lambda **other: f"sha256({' || '.join(told(other.get(c, c)) for c in COLUMNS)})"
    # In either tree: nodes of every level, then a proof and a folded digest carried up level by level.
    up = "select tree, level + 1, i // {f}, (n + {f} - 1) // {f}, sha256(string_agg(h, '' order by i)) from {t} where n > 1 group by tree, level, i // {f}, n"

    around = f"partition by tree, level, i // {FANOUT} order by i rows between"
    beside = f"select *, coalesce(string_agg(h, '') over ({around} unbounded preceding and 1 preceding), '') as a, coalesce(string_agg(h, '') over ({around} 1 following and unbounded following), '') as z from {{t}}"
    climb = "select c.tree, c.r, c.level + 1, c.i // {f}, (c.n + {f} - 1) // {f}, c.proof || s.a || s.z, sha256(s.a || c.fold || s.z) from {c} c join {t} s on s.tree = c.tree and s.level = c.level and s.i = c.i where c.n > 1"

    return f"""
with recursive {CRC_TABLE},
  d as materialized (select *, {leaf()} as leaf, {leaf(n_chars="(n_chars::hugeint + 1)")} as wrong from documents),
  b as materialized (select row_number() over () as r, doc_id, leaf, case when n_chars is not null and coalesce({crc32("cast(doc_id as varchar)")} % 7 = 0, false) then wrong else leaf end as tried, dense_rank() over (order by lang nulls first) - 1 as tree,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d, crc_table),
  nodes as (select tree, 0 as level, i, n, leaf as h from b union all {up.format(f=FANOUT, t="nodes")}),
  lower_nodes as materialized ({beside.format(t="nodes")}),
  subroots as materialized (select tree as i, h, count(*) over () as n from lower_nodes where n = 1),
  tops as (select 0 as tree, 0 as level, i, n, h from subroots union all {up.format(f=FANOUT, t="tops")}),
  upper_nodes as materialized ({beside.format(t="tops")}),
  climbed as (select tree, r, 0 as level, i, n, '' as proof, tried as fold from b union all {climb.format(f=FANOUT, c="climbed", t="lower_nodes")}),
  halfway as materialized (select c.r, c.tree, c.proof, c.fold, s.h as subroot, s.n from climbed c join subroots s on c.tree = s.i where c.n = 1),
  risen as (select 0 as tree, r, 0 as level, tree as i, n, proof, fold from halfway union all {climb.format(f=FANOUT, c="risen", t="upper_nodes")})
select b.doc_id, b.leaf, p.subroot, t.h as root, sha256(x.proof) as proof_sha256, x.fold as folded_root, x.fold = t.h as verified
from b join halfway p using (r) join risen x on x.r = b.r and x.n = 1 join upper_nodes t on t.n = 1"""


SQL: dict[str, str] = {"op2_quality_rules": quality(), "op4_maxscore": search(), "op5_mixing": mixing(), "op12_resampling": resampling(), "op13_manifest": merkle()}
