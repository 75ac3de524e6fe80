"""The registered queries of this subpackage and the SQL that some must equal."""

from __future__ import annotations

import corpus_pipeline
from corpuslab.llm import (
    contamination, extraction, language, lm, packing, pii, quality, sharding, similarity, spelling,
    substrings, toxicity, whitening,
)

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_votes, language.op2_language_crf, packing.op3_best_fit_packing,
        toxicity.op4_toxicity_automata, similarity.op5_partenum_join,
        pii.op6_pii_votes, lm.op7_bloom_lm,
        extraction.op8_tree_extraction, contamination.op9_template_leaks, sharding.op10_feistel_shards,
        spelling.op11_node_pair_variants, substrings.op12_winnowed_repeats,
        whitening.op13_weighted_whitening,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    # every pair of documents that share a shingle, and the least id that links reach
    "op5_partenum_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
             from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c
           from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
          where 100 * c >= 75 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as root from documents
          union select e.y, r.root from reach r join both_ways e on e.x = r.doc_id)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.root) as component_id
from documents d join reach r on r.doc_id = d.doc_id left join sizes z on z.doc_id = d.doc_id group by d.doc_id
""",
    # checksums by the usual bit steps; near words by every skipped position, as strings
    "op11_node_pair_variants": r"""
with recursive bits as (
  select list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
    case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as steps),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)
  where length(run) >= 7 group by 1, 2),
marks as (select low, n, xor(list_reduce(list_prepend(4294967295, list_transform(
    regexp_extract_all(hex(encode(doc_id || ':' || low)), '..'), lambda h: ('0x' || h)::bigint)),
    lambda c, b: xor(c // 256, steps[(xor(c, b) % 256)::int + 1])), 4294967295) as h from runs, bits),
words as (select word, sum(n)::bigint as n from (
    select case when h % 31 = 0 then left(low, (h % length(low))::int) || substr(low, (h % length(low))::int + 2) else low end as word, n
    from marks) where length(word) >= 7 group by word having sum(n) >= 2),
skips as (select word, n, i, left(word, i - 1) as l, substr(word, i + 1) as r
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n as m from skips a join skips b on a.i = b.i and a.l = b.l and a.r = b.r and a.word <> b.word
  union select s.word, w.word, w.n from skips s join words w on w.word = s.l || s.r
  union select w.word, s.word, s.n from skips s join words w on w.word = s.l || s.r),
best as (select word, count(*) as n_near, arg_max(other, (m, -rank)) as top, max(m) as m
  from (select *, row_number() over (order by encode(other)) as rank from near) group by word),
forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 10 * w.n then b.top end as form,
    case when b.m >= 10 * w.n then b.m end as form_n from words w left join best b on b.word = w.word),
chain as (select word, word as root, 0 as step from forms
  union all select c.word, f.form, c.step + 1 from chain c join forms f on f.word = c.root where f.form is not null)
select f.word, f.form, arg_max(c.root, c.step) as root, f.n, f.n_near, f.form_n
from forms f join chain c on c.word = f.word group by f.word, f.form, f.n, f.n_near, f.form_n
""",
    # every window as a string
    "op12_winnowed_repeats": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
windows as (select doc_id, word, i, case when count(*) over own = 35 then md5(string_agg(word, ' ') over own) end as h
  from words window own as (partition by doc_id order by i rows between current row and 34 following)),
places as (select doc_id, word, i, h is not null and count(*) over (partition by h) > 1 as twice from windows),
last as (select doc_id, word, i, max(case when twice then i end) over (partition by doc_id order by i) as start from places),
kept as (select doc_id, count(*) filter (where i - start < 35) as n_removed,
    string_agg(word, ' ' order by i) filter (where start is null or i - start >= 35) as rest from last group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.rest, '')) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id
""",
}
