"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, filter_audit, fingerprints, importance, jaccard_join, language_id, lexicon, line_dedup, lm_scoring, mixing, substring_dedup, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_to_weights(_documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, max_passes=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return lm_scoring.score(_documents(spark, sf_dir), good.select("doc_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_documents(_documents(spark, sf_dir), width=5, percent=80)
    return linked.select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_documents(spark, sf_dir)).drop("next_fingerprint")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 20 == 0, k=20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(_documents(spark, sf_dir), width=35)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(_documents(spark, sf_dir), labels, folds=5, held_out=0)


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_decode(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir), folds=4, held_out=2)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(_documents(spark, sf_dir), least_docs=3, least_chars=20)
    return done.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(_documents(spark, sf_dir), target, percent=25, least_words=20, order=2, buckets=10_000, seed=7)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_token_files": op4_token_files,
        "op5_fingerprints": op5_fingerprints,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_bpe_lexicon": op9_bpe_lexicon,
        "op10_language_id": op10_language_id,
        "op11_line_dedup": op11_line_dedup,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_filter_audit": op13_filter_audit,
    }


#: md5 thresholds as a running sum over each source, which the Spark form avoids.
OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (array[3.0, 1.0, 2.0])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight,
         source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as budget
  from sizes),
levels as (
  select *, cap / weight as fill,
         (budget - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (w rows between current row and unbounded following) as level
  from weighed window w as (order by cap / weight, source is null, source)),
chosen as (select *, (select min_by(level, fill) from levels where fill >= level) as common from levels),
targets as (select source, source_size, round(least(common * weight, cap), 6) as target from chosen),
planned as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from targets),
summed as (
  select s.*, p.source_size, p.target, p.passes, floor(p.target - p.passes * p.source_size)::bigint as rest,
         sum(s.size) over (partition by s.source order by s.hash range between unbounded preceding and current row) as upto,
         sum(s.size) over (partition by s.source, s.hash) as own
  from sized s join planned p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (passes * size + case when upto <= rest then size
                             when upto - own <= rest and own > 0 then floor((rest - (upto - own)) * size / own)
                             else 0 end)::bigint as taken
from summed
"""

OP11_SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.place, k.line, r.keeper is not null and r.keeper <> k.doc_id as gone
  from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

#: crc32 by its table, which the rule of its polynomial gives.
OP12_SQL = r"""
with recursive crc_bits as (
  select n::bigint as n, n::bigint as c, 0 as k from range(256) t(n)
  union all
  select n, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8),
crc as (select list(c order by n) as steps from crc_bits where k = 8),
texts as (
  select 'd' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark),
worded as (
  select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from texts),
features as (
  select side, id, unnest(words) as feature from worded
  union all
  select side, id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) from worded),
counted as (select side, id, feature, count(*)::bigint as n from features group by all),
hexed as (select distinct feature, hex(encode(feature)) as h from counted),
hashed as (
  select feature, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)),
    lambda acc, b: xor(acc >> 8, steps[xor(acc & 255, b) + 1]))) % 10000 as bucket
  from hexed, crc),
bagged as (select side, id, bucket, sum(n)::bigint as n from counted join hashed using (feature) group by all),
sums as (
  select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 't'), 0)::double as t from bagged group by bucket),
totals as (select sum(s) as all_s, sum(t) as all_t from sums),
gains as (
  select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from sums, totals),
weighed as (
  select id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from bagged join gains using (bucket) where side = 'd' group by id),
scored as (
  select w.id as doc_id, len(words) >= 20 as able, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from worded w left join weighed g on w.id = g.id where w.side = 'd'),
placed as (
  select *, row_number() over (partition by able order by score desc, doc_id) as place, count(*) over (partition by able) as n from scored)
select doc_id, n_features, weight, score, case when able and place <= n * 25 // 100 then place::bigint end as rank
from placed
"""

OP13_SQL = r"""
with recursive firsts as (select coalesce(text, '') as text, min(doc_id) as first from documents group by all),
judged as (
  select d.doc_id, coalesce(d.source, '') as part, coalesce(d.text, '') as text, f.first < d.doc_id as copy,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as words
  from documents d join firsts f on coalesce(d.text, '') = f.text),
masked as (
  select doc_id, part,
         (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
         + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * copy::int as mask
  from judged),
known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
counted as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(bad), 0) as bad
  from masked left join known using (doc_id) group by all),
letters as (select c, 2 ** i as bit from (values ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) t(c, i)),
orders as (
  select '' as filter_order union all
  select o.filter_order || l.c from orders o join letters l on not contains(o.filter_order, l.c)),
steps as (
  select o.filter_order, s.step::int as step, l.c, l.bit::bigint as bit,
         coalesce((select sum(x.bit) from letters x where contains(substr(o.filter_order, 1, (s.step - 1)::int), x.c)), 0)::bigint as earlier
  from orders o, range(1, 6) s(step), letters l where len(o.filter_order) = 5 and l.c = substr(o.filter_order, s.step::int, 1)),
audited as (
  select part, filter_order, step, c,
         sum(n) filter (mask & (earlier | bit) = 0) as kept,
         sum(n) filter (mask & bit <> 0 and mask & earlier = 0) as removed,
         sum(n) filter (mask & bit <> 0 and mask & earlier <> 0) as redundant,
         sum(n) filter (mask = bit) as unique_fails,
         sum(good) filter (mask & bit <> 0 and mask & earlier = 0) as good_lost,
         sum(bad) filter (mask & bit <> 0 and mask & earlier = 0) as toxic_lost
  from counted, steps group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       sum(coalesce(removed, 0)) over (partition by part, c)::bigint as shapley
from audited
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": OP1_SQL, "op11_line_dedup": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_filter_audit": OP13_SQL}
