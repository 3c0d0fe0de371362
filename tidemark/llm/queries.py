"""The queries op1 to op10 over the documents, pages and embeddings tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, exact_dedup, html_extract, jaccard, langid, line_dedup, mixing, quality, sp_codec, token_count

#: Name, among the public tokenizers, of the model that op4, op5 and the pipeline use.
MODEL = "piece_bpe_32k.model"
#: The tree of op1: domains by source, then languages, then sources; what isn't named weighs 1.
MIX_WEIGHTS = {"web": 4, "d0": 3, "d1": 2, "d2": 1, "web/en": 3, "web/es": 2, "d0/en": 4, "d0/de": 3, "d0/es": 9, "d1/fr": 5, "d2/en": 2, "d0/en/src3": 3, "d1/en/src1": 2}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 120, 2, 17


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_levels() -> dict[str, Column]:
    number = F.regexp_extract("source", r"^src(\d+)$", 1)
    domain = F.when(F.col("source") == "src0", "web").when(number != "", F.concat(F.lit("d"), (number.cast("int") % 3).cast("string"))).otherwise("other")
    return {"domain": F.when(F.col("source").isNull(), "other").otherwise(domain), "lang": F.col("lang"), "source": F.col("source")}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to."""
    path = model_path()
    ids = sp_codec.encode(table(spark, sf_dir, "documents"), path)
    back = sp_codec.decode(ids, path, carry=("n_tokens", "ids"))
    return back.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_quality_classifier, op3_ngram_jaccard_join, op4_token_counts, op5_sentencepiece_codec, op6_language_id, op7_html_extraction, op8_exact_dedup, op9_embedding_near_dedup, op10_line_dedup)
    return {f.__name__: f for f in own}


def _share_out(above: str, parents: list[str], name: str) -> str:
    """SQL for one level of the budget tree: nodes, then what each gets of its parent's budget."""
    here, by = ", ".join([*parents, name]), f"partition by {', '.join(parents)}" if parents else ""
    using = f"join {above} using ({', '.join(parents)})" if parents else f"cross join {above}"
    path = "concat_ws('/', " + here + ")"
    return f"""
{name}_0 as (select {here}, sum(cap)::hugeint cap, sum(tokens)::hugeint tokens, greatest(coalesce(any_value(w.weight), 1), 1)::hugeint weight
             from leaves left join weights w on w.path = {path} group by {here}),
{name}_1 as (select n.*, least(a.got, sum(cap) over ({by}))::hugeint budget from {name}_0 n {using.replace(above, above + " a")}),
{name}_2 as (select *, cap * sum(weight) over ({by} order by cap::double / weight::double, {name} rows between current row and unbounded following)
             <= (budget - coalesce(sum(cap) over ({by} order by cap::double / weight::double, {name} rows between unbounded preceding and 1 preceding), 0)) * weight as is_full from {name}_1),
{name}_3 as (select *, budget - sum(case when is_full then cap else 0 end) over ({by}) pool, sum(case when is_full then 0 else weight end) over ({by}) shares from {name}_2),
{name}_4 as (select *, case when not is_full then pool::hugeint * weight // shares::hugeint end part, case when not is_full then pool::hugeint * weight % shares::hugeint end rest from {name}_3),
{name}_5 as (select *, pool - coalesce(sum(part) over ({by}), 0) over_, row_number() over ({by} order by is_full, rest desc, {name}) turn from {name}_4),
{name}_got as (select {here}, tokens, (case when is_full then cap else part + case when turn <= over_ then 1 else 0 end end)::hugeint got from {name}_5)"""


def _mix_sql() -> str:
    weights = ", ".join(f"('{p}', {w})" for p, w in MIX_WEIGHTS.items())
    return f"""
with weights(path, weight) as (values {weights}),
d as (select doc_id, case when source = 'src0' then 'web' when regexp_matches(source, '^src[0-9]+$') then 'd' || (substr(source, 4)::int % 3) else 'other' end as domain,
      coalesce(lang, '-') lang, coalesce(source, '-') source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
r as (select * from d where n_tokens > 0),
leaves as (select domain, lang, source, sum(n_tokens) tokens, sum(n_tokens) * {MIX_EPOCHS} cap from r group by all),
root as (select (sum(tokens)::hugeint * {MIX_BUDGET} // 100) got from leaves),
{_share_out("root", [], "domain")},
{_share_out("domain_got", ["domain"], "lang")},
{_share_out("lang_got", ["domain", "lang"], "source")},
state as (select domain, lang, source, (got // tokens)::bigint full_epochs, (got % tokens)::bigint rest from source_got where got > 0),
k as (select r.*, full_epochs, rest, md5('{MIX_SEED}:' || full_epochs || ':' || coalesce(doc_id::varchar, '-')) key from r join state using (domain, lang, source)),
c as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by key, doc_id nulls last rows between unbounded preceding and 1 preceding), 0) start from k),
t as (select *, greatest(0, least(n_tokens, rest - start))::bigint part_tokens from c)
select doc_id, domain, lang, source, n_tokens, full_epochs, part_tokens, (full_epochs * n_tokens + part_tokens)::bigint taken_tokens from t where full_epochs * n_tokens + part_tokens > 0"""


_JACCARD_SQL = """
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh from w),
e as (select doc_id, unnest(sh) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
n as (select doc_id, len(sh) n from s),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ as (select a, b from l union all select b, a from l),
r as (select doc_id x, doc_id y from n union select r.x, both_.b from r join both_ on r.y = both_.a)
select n.doc_id, n.n::bigint n_shingles, m.component_id from n join (select x, min(y) component_id from r group by x) m on m.x = n.doc_id"""

_EXACT_SQL = """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id is not distinct from max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))"""

_EMBED_SQL = """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
g as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id x, vec_id y from v union select r.x, l.b from r join l on r.y = l.a),
m as (select x, min(y) c from r group by x), k as (select a, count(*) n from l group by a)
select v.vec_id, coalesce(k.n, 0)::bigint n_links, m.c as component_id, v.vec_id = m.c as kept from v join m on m.x = v.vec_id left join k on k.a = v.vec_id"""

_LINES_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
w as (select doc_id, l, unnest(range(0, len(l) - 2)) i from d where len(l) > 2),
t as (select doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] x from w where regexp_replace(l[i + 1] || l[i + 2] || l[i + 3], '\\s', '', 'g') <> ''),
o as (select doc_id, i, row_number() over (partition by x order by doc_id, i) r from t),
c as (select doc_id, list(distinct j) js from (select doc_id, unnest([i, i + 1, i + 2]) j from o where r > 1) group by doc_id)
select d.doc_id, len(l)::bigint n_lines, coalesce(len(js), 0)::bigint n_removed,
       case when js is null then array_to_string(l, chr(10)) else coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: not list_contains(js, i)), lambda i: l[i + 1]), chr(10)), '') end as text
from d left join c on c.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _mix_sql(), "op3_ngram_jaccard_join": _JACCARD_SQL, "op8_exact_dedup": _EXACT_SQL, "op9_embedding_near_dedup": _EMBED_SQL, "op10_line_dedup": _LINES_SQL}
