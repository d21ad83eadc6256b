"""The queries of this package, one for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, fm, linedup, neardup, packing, pii, pst, quality, spelling, tables, tokenfile, turns, winnow


def public_file(name: str) -> str:
    """The place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.toxicity(tables.documents(spark, sf_dir), labels(spark, sf_dir))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(tables.documents(spark, sf_dir))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(tables.documents(spark, sf_dir), public_file("byte_bpe_50k.json")).drop("same")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(tables.documents(spark, sf_dir))


def op5_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(tables.documents(spark, sf_dir), labels(spark, sf_dir))


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(tables.documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.new_path(spark, "tokens")
    tokenfile.write(tables.documents(spark, sf_dir), public_file("word_bpe_49k.json"), out)
    return tokenfile.read(spark, out)


def op8_decontaminate_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(tables.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(tables.documents(spark, sf_dir))


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.scores(tables.documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(tables.documents(spark, sf_dir))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables.documents(spark, sf_dir), public_file("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_toxicity_fm, op2_winnowing, op3_bpe_encode_decode, op4_pii_anchors, op5_quality_pu, op6_minhash_bayes, op7_token_files, op8_decontaminate_fm, op9_line_dedup, op10_suffix_tree_lm, op11_conversation_repair, op12_spelling_variants, op13_best_fit_packing)}

#: A-Z lower-cased
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
links as materialized (select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by all) p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * c >= 75 * (na.n + nb.n - c)),
reach as (select a as doc_id, b as other from links union select reach.doc_id, links.b from reach join links on links.a = reach.other),
least_id as (select doc_id, min(other) as least_other from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(least_other, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(least_other, d.doc_id)) as kept from d left join n using (doc_id) left join least_id using (doc_id)"""

_OP8 = rf"""with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, least(len(w), 13) as size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i, w from b where len(w) > 0),
keys as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as key from bw),
dw as (select doc_id, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as i, w from d, (select distinct size from keys)),
hits as (select doc_id, item_id, i, size from (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as key from dw) join keys using (size, key)),
places as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join places using (doc_id) left join items using (doc_id)"""

#: Prefixes in SQL too, as lines with a common word are too many; any order of tokens gives the same result
_OP9 = r"""with p as (select doc_id, string_split(text, chr(10)) as raw, string_split(translate(lower(text), chr(9) || chr(13) || chr(11) || chr(12), '    '), chr(10)) as lines from documents),
l as (select doc_id, line_no, list_sort(list_distinct(list_filter(string_split(line, ' '), lambda x: x <> ''))) as ws from (select doc_id, unnest(range(len(lines))) as line_no, unnest(lines) as line from p)),
w as materialized (select *, row_number() over (order by doc_id, line_no) as place from l where len(ws) > 0),
r as materialized (select ws, min(place) as a, len(ws) as n from w group by ws),
t as (select a, n, unnest(ws) as tok from r),
o as (select a, n, tok, row_number() over (partition by a order by k, tok) as i from t join (select tok, count(*) as k from t group by tok) using (tok)),
h as materialized (select a, n, tok from o where i <= n - (n * 80 + 99) // 100 + 1),
c as (select distinct x.a as a, y.a as b from h x join h y on x.tok = y.tok and x.a < y.a and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
gone as (select distinct c.b as place from c join r x on x.a = c.a join r y on y.a = c.b where 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n) union select place from w join r using (ws) where place > a),
d as (select doc_id, count(*) as k, string_agg(line_no, ',' order by line_no) as removed from gone join w using (place) group by doc_id)
select doc_id, cast(coalesce(len(raw), 0) as bigint) as n_lines, coalesce(k, 0) as n_removed, coalesce(removed, '') as removed from p left join d using (doc_id)"""

#: DuckDB SQL, where SQL can express a query over whole tables
ORACLES: dict[str, str] = {"op6_minhash_bayes": _OP6, "op8_decontaminate_fm": _OP8, "op9_line_dedup": _OP9}
