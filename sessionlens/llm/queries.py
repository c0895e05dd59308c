"""The queries of the corpus operators, and the DuckDB SQL each must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.alignment import align_tokens, alignment_scores, pair_counts
from sessionlens.llm.common import lower_ascii
from sessionlens.llm.decontaminate import contained_items
from sessionlens.llm.jaccard_join import jaccard_components
from sessionlens.llm.language_id import address_host, address_suffix, identify_language, markup_language
from sessionlens.llm.line_dedup import line_dedup
from sessionlens.llm.main_text import extract_main_text
from sessionlens.llm.merkle import FIELDS, fold, hex_text, leaf_digest, merkle_proofs, proof_digest
from sessionlens.llm.mixing import mix
from sessionlens.llm.quality import quality_scores
from sessionlens.llm.simhash import simhash_components
from sessionlens.llm.surrogates import replace_personal_data
from sessionlens.llm.topk import top_k
from sessionlens.llm.warc import read_warc, resolved, write_warc
from sessionlens.sources.sinks import drop_staged, stage_path, staged

SURROGATE_KEY = b"a key for tests; a corpus takes its own"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = replace_personal_data(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return kept.select("doc_id", "text", "replaced")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents")).drop("key")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages, with all four kinds of evidence; the text is that of the whole page."""
    pages = _table(spark, sf_dir, "pages").withColumn("host", address_host(F.col("url")))
    pages = pages.withColumn("suffix", address_suffix(F.col("host"))).withColumn("declared", markup_language(F.col("html")))
    found = identify_language(pages, "html", "page_id", "declared", "host", "suffix")
    return found.drop("key").withColumnRenamed("doc_id", "page_id")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    one = mixed.withColumn("_row", F.explode(F.expr("sequence(1, cast(rows as int))")))
    return one.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not drawn in the mix: sizes and targets."""
    return op9_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not learned in the quality scores: which documents are held out, and that a score is a share and its cut is right."""
    scored = op2_quality(spark, sf_dir)
    fits = F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.7).cast("int"))
    return scored.select("doc_id", "held_out", fits.alias("fits"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"), report=True)
    return kept.select("doc_id", "text", "lines_cut", "words_cut")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = staged(align_tokens(_table(spark, sf_dir, "documents")))
    counts = pair_counts(aligned)
    scores = alignment_scores(aligned, counts)
    drop_staged(aligned, counts)
    return scores.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    claim = leaf_digest(*[tampered if f == "text" else F.col(f) for f in FIELDS])
    proofs = merkle_proofs(_table(spark, sf_dir, "documents"), claim=claim)
    proofs = proofs.withColumn("folded", fold(F.col("claim"), F.col("steps")))
    names = {"leaf": "leaf", "subroot": "subroot", "root": "root", "folded": "folded_root"}
    texts = [hex_text(F.col(c)).alias(name) for c, name in names.items()]
    return proofs.select("doc_id", *texts, hex_text(proof_digest(F.col("steps"))).alias("proof_sha256"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_surrogates": op6_surrogates,
    "op7_main_text": op7_main_text,
    "op8_language_id": op8_language_id,
    "page_languages": page_languages,
    "op9_mix": op9_mix,
    "op10_line_dedup": op10_line_dedup,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
    "mix_targets": mix_targets,
    "quality_folds": quality_folds,
}

_WORDS = r"""list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_TRIM = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"
_SHINGLES = """case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end"""



def _climb(name: str, by: str, levels: int) -> str:
    """CTEs that take {name}_n0 (by, idx, n, d) up to one node for each by, and {name}_p0 (its rows, proof, cur) with it."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_r{k} as (select {by}, idx // 8 as run, n, list(d order by idx) as ds from {name}_n{k} group by {by}, idx // 8, n),
{name}_n{k + 1} as (select {by}, run as idx, (n + 7) // 8 as n, case when n = 1 then ds[1] else sha256(list_aggregate(ds, 'string_agg', '')) end as d from {name}_r{k}),
{name}_x{k} as (select p.* exclude (proof, cur), p.proof, p.cur, r.n as m, coalesce(list_aggregate(r.ds[1:(p.idx // {8**k}) % 8], 'string_agg', ''), '') as lhs,
  coalesce(list_aggregate(r.ds[(p.idx // {8**k}) % 8 + 2:], 'string_agg', ''), '') as rhs
  from {name}_p{k} p join {name}_r{k} r on p.{by} is not distinct from r.{by} and p.idx // {8 ** (k + 1)} = r.run),
{name}_p{k + 1} as (select * exclude (proof, cur, m, lhs, rhs), proof || lhs || rhs as proof, case when m = 1 then cur else sha256(lhs || cur || rhs) end as cur from {name}_x{k})""")
    return ",\n".join(out)


_FIELD = "case when {0} is null then '-' else octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar end"
_LEAF = " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(list_reduce(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint),
  lambda c, b: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""
_MERKLE = f"""
with claims as (select *, case when {_CRC} % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as told from documents),
leaves as (select doc_id, lang, sha256({_LEAF} || {_FIELD.format("text")}) as leaf, sha256({_LEAF} || {_FIELD.format("told")}) as claim from claims),
a_p0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, '' as proof, claim as cur from leaves),
a_n0 as (select lang, idx, count(*) over (partition by lang) as n, leaf as d from a_p0),
{_climb("a", "lang", 7)},
b_n0 as (select 0 as one, lang, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n, d from a_n7),
b_p0 as (select p.doc_id, p.leaf, p.proof, p.cur, r.d as subroot, r.idx, 0 as one from a_p7 p join b_n0 r on p.lang is not distinct from r.lang),
{_climb("b", "one", 3)}
select p.doc_id, p.leaf, p.subroot, r.d as root, sha256(p.proof) as proof_sha256, p.cur as folded_root, p.cur = r.d as verified from b_p3 p, b_n3 r"""

ORACLES = {
    "op1_decontaminate": f"""
with words as (select doc_id, coalesce({_WORDS}, []) as w from documents),
asked as (select item_id, coalesce({_WORDS}, []) as w from benchmark),
shingles as (select doc_id, unnest({_SHINGLES}) as t from words),
items as (select item_id, {_SHINGLES} as s from asked),
parts as (select i.item_id, len(s) as n, unnest(s) as t from items i join asked a on a.item_id = i.item_id where len(a.w) >= 5)
select d.doc_id, p.item_id, p.n as item_shingles, count(*) as shared from shingles d join parts p on d.t = p.t
group by d.doc_id, p.item_id, p.n having 4 * count(*) >= 3 * p.n""",
    "op3_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 10""",
    "op4_jaccard_join": f"""
with recursive words as (select doc_id, coalesce({_WORDS}, []) as w from documents),
sets as (select doc_id, {_SHINGLES} as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as t from sets),
links as (select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 175 * count(*) >= 75 * (a.n + b.n)),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, len(s) as n_shingles, min(r.y) as component_id
from sets s join reach r on s.doc_id = r.x group by s.doc_id, len(s)""",
    "op5_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
    "op10_line_dedup": f"""
with split as (select doc_id, string_split(text, chr(10)) as parts from documents where text <> ''),
raw as (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as part from split),
lines as (select doc_id, pos, regexp_replace(part, {_TRIM}) as line,
  len(list_filter(regexp_split_to_array(part, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words from raw),
numbered as (select *, row_number() over (partition by doc_id order by pos) as seq,
  sum(words) over (partition by doc_id order by pos) as stop from lines where line <> ''),
windows as (select a.doc_id, a.seq as first, min(b.seq) as last from numbered a join numbered b
    on a.doc_id = b.doc_id and b.seq >= a.seq and b.stop >= a.stop - a.words + 50 group by all
  union select b.doc_id, max(a.seq) as first, b.seq as last from numbered a join numbered b
    on a.doc_id = b.doc_id and a.seq <= b.seq and a.stop - a.words <= b.stop - 50 group by b.doc_id, b.seq),
runs as (select w.doc_id, w.first, w.last, string_agg(n.line, chr(10) order by n.seq) as body
  from windows w join numbered n on n.doc_id = w.doc_id and n.seq between w.first and w.last group by all),
ordered as (select *, row_number() over (partition by body order by doc_id, first) as copy from runs),
cut as (select distinct n.doc_id, n.seq, n.pos from ordered o join numbered n
  on n.doc_id = o.doc_id and n.seq between o.first and o.last where o.copy > 1),
stretches as (select doc_id, min(pos) as first, max(pos) as last, count(*) as n
  from (select *, seq - row_number() over (partition by doc_id order by seq) as g from cut) group by doc_id, g),
marked as (select l.*, exists (select 1 from stretches s where s.doc_id = l.doc_id and l.pos between s.first and s.last) as gone
  from (select l.doc_id, l.pos, l.words, r.part from lines l join raw r on l.doc_id = r.doc_id and l.pos = r.pos) l),
kept as (select doc_id, coalesce(string_agg(part, chr(10) order by pos) filter (where not gone), '') as text,
  coalesce(sum(words) filter (where gone), 0) as words_cut from marked group by doc_id),
counts as (select doc_id, sum(n) as lines_cut from stretches group by doc_id)
select d.doc_id, coalesce(k.text, d.text) as text, coalesce(c.lines_cut, 0)::bigint as lines_cut,
  coalesce(k.words_cut, 0)::bigint as words_cut
from documents d left join kept k on d.doc_id = k.doc_id left join counts c on d.doc_id = c.doc_id""",
    "op13_merkle": _MERKLE,
    "quality_folds": f"select doc_id, {_CRC} % 4 = 2 as held_out, true as fits from documents",
    "mix_targets": f"""
with d as (select doc_id, source, len(coalesce({_WORDS}, [])) as size from documents),
s as (select source, sum(size)::bigint as size, [5, 2, 1][(row_number() over (order by source nulls last) - 1)::int % 3 + 1]::double as w from d group by source),
r as (select *, sum(size) over () as total, coalesce(sum(3 * size) over before, 0) as capped, sum(w) over rest as open
  from s window before as (order by 3 * size / w, source rows between unbounded preceding and 1 preceding),
  rest as (order by 3 * size / w, source rows between current row and unbounded following)),
level as (select max((total - capped) / open) as share from r)
select d.doc_id, d.size, s.size as source_size, round(least(3 * s.size, s.w * l.share), 3) as target
from d join s on d.source is not distinct from s.source, level l""",
}
