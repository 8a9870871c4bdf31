"""One query per operator over its whole table, and the SQL that states the same result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollstat.llm.chat import format_chats
from rollstat.llm.common import table
from rollstat.llm.exact_dedup import exact_duplicates
from rollstat.llm.language import identify
from rollstat.llm.licenses import TEMPLATES, scan_licenses
from rollstat.llm.mixing import mixture
from rollstat.llm.neighbours import embedding_near_duplicates
from rollstat.llm.packing import pack
from rollstat.llm.periods import periodic_runs, run_digest, with_planted_tails
from rollstat.llm.quality import score_quality
from rollstat.llm.rules import judge_quality
from rollstat.llm.simhash import simhash_near_duplicates
from rollstat.llm.toxicity import score_toxicity
from rollstat.llm.variants import count_words, spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tokenizer_path(name: str) -> str:
    """Vocabularies are read where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_mixing", r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 16) as hash_key
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size,
         [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from d group by source
), o as (
  select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) as place, 3.0 * source_size as top from s
), p as (
  select *, sum(source_size) over () - coalesce(sum(top) over (order by place rows between unbounded preceding and 1 preceding), 0) as left_words,
         sum(weight) over (order by place rows between current row and unbounded following) as left_weight
  from o
), w as (
  select left_words, left_weight from p where top >= weight * left_words / left_weight order by place limit 1
), t as (
  select p.source, p.source_size, least(p.top, p.weight * cast(w.left_words as double) / w.left_weight) as target from p, w
), r as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5) as budget,
         sum(d.size) over (partition by d.source order by d.hash_key, d.doc_id, d.size rows between unbounded preceding and current row) as until_words
  from d join t on d.source is not distinct from t.source
), e as (
  select *, case when source_size > 0 then floor(budget / source_size) else 0 end as epochs from r
)
select doc_id, cast(size as bigint) as size, source_size, cast(target as double) as target,
       cast(epochs * size + least(greatest(budget - epochs * source_size - (until_words - size), 0), size) as bigint) as taken
from e
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3.0)


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out_fold=0, threshold=0.5)


@register("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held_out_fold=2)


def _license_sql(threshold: float = 0.75, covers: float = 0.5) -> str:
    """The scan without its pruning: every line, header and paragraph of every document against every template.

    No document's path names a licence file, so there are no windows; the rule for names is stated all the same.
    """
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    return rf"""
with templates(i, license, body) as (values {rows}),
tt as (
  select i, license, w, count(*) as n from (select i, license, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) as w from templates) where w <> '' group by all
), files as (
  select doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(cast(doc_id as varchar), '')) as path, coalesce(text, '') as body from documents
), total as (select count(*) as n from files),
df as (
  select w, count(*) as n from (select distinct doc_id, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) as w from files) where w in (select w from tt) group by w
), idf as (
  select distinct tt.w, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 as idf from tt left join df on tt.w = df.w, total
), tw as (
  select i, license, tt.w, n * idf / sqrt(sum(n * idf * n * idf) over (partition by i)) as weight from tt join idf on tt.w = idf.w
), units as (
  select doc_id, path, 0 as unit, string_split_regex(body, '
?
[ 	]*
?
')[1] as line, body from files
  union all
  select doc_id, path, unnest(range(1, len(string_split_regex(body, '[
]+')) + 1)) as unit, unnest(string_split_regex(body, '[
]+')) as line, body from files
  union all
  select doc_id, path, 1000000 + unnest(range(1, len(string_split_regex(body, chr(10) || '(?:[ \t\r]*[#*/;%!-]*[ \t\r]*' || chr(10) || ')+')) + 1)) as unit,
         unnest(string_split_regex(body, chr(10) || '(?:[ \t\r]*[#*/;%!-]*[ \t\r]*' || chr(10) || ')+')) as line, body from files
), uw as (
  select doc_id, unit, w, count(*) as tf from (select doc_id, unit, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) as w from units) where w <> '' group by all
), uv as (
  select doc_id, unit, uw.w, tf, tf * coalesce(idf, (select ln(n + 1) + 1 from total)) as value from uw left join idf on uw.w = idf.w
), norms as (
  select doc_id, unit, sqrt(sum(value * value)) as norm, sum(tf) as length from uv group by all
), dots as (
  select doc_id, unit, i, license, sum(value * weight) as dot from uv join tw on uv.w = tw.w group by all
), scored as (
  select d.doc_id, d.unit, i, license, round(dot / norm, 6) as score, length from dots d join norms n on d.doc_id = n.doc_id and d.unit = n.unit
), words as (
  select doc_id, len(list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda x : x <> '')) as words from files
), best as (
  select s.doc_id, license, score, length / words as covered from scored s join words on s.doc_id = words.doc_id where score >= {threshold}
  qualify row_number() over (partition by s.doc_id order by score desc, i, length desc, unit) = 1
), own as (
  select f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') as dir, license, score, covered from files f left join best b on f.doc_id = b.doc_id
), declared as (
  select dir, license from own where license is not null and (covered >= {covers} or regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)([.\-][^/]*)?$'))
  qualify row_number() over (partition by dir order by score desc, path) = 1
), up as (
  select doc_id, declared.license as inherited, declared.dir as from_dir from own join declared on own.dir = declared.dir or starts_with(own.dir, declared.dir || '/')
  where own.license is null qualify row_number() over (partition by doc_id order by length(declared.dir) desc) = 1
)
select own.doc_id, path, license, score, inherited, from_dir as inherited_from from own left join up on own.doc_id = up.doc_id
"""


@register("op4_licenses", _license_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "doc_id")])
    return scan_licenses(docs, path, threshold=0.75, covers=0.5)


@register("op7_chat", r"""
with d as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations
), p as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n_turns,
         string_agg(role || chr(31) || body, chr(30)) over (partition by conv_id order by turn nulls last, role, body rows between unbounded preceding and current row) as prefix
  from d window w as (partition by conv_id order by turn nulls last, role, body)
), f as (
  select prefix, n_turns, min(conv_id) as conv_id, count(*) as copies from p where pos = n_turns group by prefix, n_turns
), m as (
  select * from f where not exists (select 1 from p where p.pos < p.n_turns and p.prefix = f.prefix)
)
select p.conv_id, cast(floor((pos - 1) / 1024) as integer) as part, p.n_turns, m.copies,
       string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' order by pos) as text
from p join m on p.conv_id is not distinct from m.conv_id group by p.conv_id, part, p.n_turns, m.copies
""")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


@register("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, folds=5, held_out_fold=0)


@register("op6_exact_dedup", r"""
with t as (
  select doc_id, coalesce(text, '') as body from documents
), n as (
  select doc_id, length(body) as points, regexp_replace(body, '[\x20\x09-\x0D]', '', 'g') as norm from t
), g as (
  select *, count(*) over (partition by norm) as group_size,
         row_number() over (partition by norm order by points desc, doc_id nulls last) as place,
         first_value(doc_id) over (partition by norm order by points desc, doc_id nulls last) as keep_id
  from n
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from g
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@register("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


@register("op10_embeddings")
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


@register("op11_periods")
def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = with_planted_tails(F.col("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return run_digest(periodic_runs(docs, "doc_id", text, least=24, exponent=3))


@register("op12_variants")
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), shortest=5, slip=97)
    return spelling_variants(words.filter("n >= 3"), ratio=2)


@register("op13_rules")
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("good")).alias("kept"), "posterior")
