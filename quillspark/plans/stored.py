"""Queries that write whole tables with the library's sinks, read them back with its sources and return what was
read, with the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, decoding, ensemble, evaluation, relations
from ..shared import fresh_path, spread, written
from ..sources import filetree, models, readers, writers
from . import catalogue
from .catalogue import SOURCES_SQL, manifest, pairs, sources, table


def s01_manifest(spark, sf_dir):
    """Texts with line breaks, quotes and white space at their ends, and nulls, as a CSV of typed columns."""
    path, d = fresh_path(spark), table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(' "'), "text", F.lit('", said\r\n '))).when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, F.col("text"))
    writers.csv(d.select(F.col("doc_id").alias("ID"), text.alias("Target"), (F.col("doc_id") % 7).alias("fold"), (F.col("doc_id") / 4).alias("width")), path, rows=1000)
    x = readers.manifest(spark, path, "width double, ID long, Target string")
    t = F.coalesce("Target", F.lit(""))  # a CSV doesn't part an empty text from null when it is read
    return x.select("ID", "width", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


def s07_source_files(spark, sf_dir):
    """Five files of predictions, named by specs, read, checked for one set of IDs and stacked."""
    x, own = sources(spark, sf_dir), {}
    for k in range(5):
        path = fresh_path(spark)
        writers.csv(x.where(F.col("source_idx") == k).select("ID", F.col("text").alias("Target")), path, ["ID"])
        name, where = readers.parse_spec(f"s{k}:{path}")
        own[name] = readers.predictions(spark, where, name)
    anchor, *rest = own
    ensemble.require_same_ids(own[anchor], {k: own[k] for k in rest})
    return ensemble.stacked(own)


def j06_same_order(spark, sf_dir):
    """Sources whose rows are held to be in one order, by their places in files, and then voted on."""
    x, own = sources(spark, sf_dir), {}
    for k in range(5):
        path = fresh_path(spark)
        writers.csv(x.where(F.col("source_idx") == k).select("ID", F.col("text").alias("Target")), path, ["ID"])
        own[str(k)] = readers.in_order(spark, path, place="pos").withColumn("Target", F.coalesce("Target", F.lit("")))
    ensemble.require_same_order(own)
    return ensemble.weighted(ensemble.stacked(own), {0: 2.0, 3: 1.5})


def j07_grouped_shapes(spark, sf_dir):
    """Row errors with the shapes of another table, in groups; every row must have a shape."""
    shapes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), (F.col("p_partkey") % 30).cast("double").alias("aspect_ratio"), F.col("p_size").alias("width"))
    x = relations.attach(evaluation.row_errors(pairs(spark, sf_dir)), shapes, "ID", "aspect_ratio")
    return evaluation.grouped(evaluation.slices(x))


def k02_row_errors(spark, sf_dir):
    """An evaluation as files: row errors in their order."""
    path = fresh_path(spark)
    x = written(evaluation.row_errors(pairs(spark, sf_dir)))  # a summary and a sort, which samples first, read it
    writers.evaluation_bundle(evaluation.corpus_summary(x), x, evaluation.confusions(pairs(spark, sf_dir)), path)
    return readers.in_order(spark, f"{path}/row_errors", "ID string, reference string, prediction string, char_edits long, row_cer double").withColumns({"prediction": F.coalesce("prediction", F.lit("")), "row_cer": F.round("row_cer", 6)})


def k03_grouped_files(spark, sf_dir):
    """The summary of groups as a file, in the order of its rows."""
    path = fresh_path(spark)
    x = evaluation.slices(written(evaluation.row_errors(pairs(spark, sf_dir))).withColumn("aspect_ratio", F.expr("cast(ID as double) % 30")))
    writers.grouped_bundle(x, evaluation.grouped(x), path)
    return readers.in_order(spark, f"{path}/grouped_error_summary", "group_name string, group_value string, n long, mean_row_cer double, mean_char_edits double")


def k04_charset_files(spark, sf_dir):
    """Characters from the rarest, as a file."""
    path, part = fresh_path(spark), table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"))
    writers.charset_bundle(audit.char_frequency(part, "t", "p_partkey"), audit.rare_lines(part, "t", "p_partkey", most=400), path)
    return readers.in_order(spark, f"{path}/character_frequency", "ch string, n long, n_rows long")


def k05_alignment_files(spark, sf_dir):
    """The audit of time steps as a file, the least margin first."""
    path = fresh_path(spark)
    x = audit.ctc_alignment(manifest(spark, sf_dir))
    writers.audit_bundle(x, audit.ctc_summary(x), path, ["ctc_margin", "ID"])
    return readers.in_order(spark, f"{path}/audit", "ID string, ctc_margin long, is_ctc_length_valid boolean, text string").withColumn("text", F.md5(F.coalesce("text", F.lit(""))))


def k10_symbol_file(spark, sf_dir):
    """An alphabet's symbols with their ids, as a file."""
    path = fresh_path(spark)
    every = table(spark, sf_dir, "part").select(F.explode(T.chars(F.col("p_name"))).alias("ch")).agg(F.collect_set("ch").alias("a"))
    writers.symbol_file(every.select(F.posexplode(T.symbol_list(F.col("a"))).alias("idx", "symbol")), path)
    return readers.symbols(spark, path)


def k13_label_lines(spark, sf_dir):
    """Label lines of three splits, with texts normalised and paths relative to a root."""
    path = fresh_path(spark)
    n = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(F.concat(F.lit("/data/im/"), n, F.lit(".jpg")).alias("image_path"), F.concat(F.lit("  "), "p_name", F.lit(" \n "), "p_brand").alias("Target"), F.when(n % 5 == 0, "test").when(n % 5 == 1, "valid").otherwise("train").alias("split"))
    writers.paddle_dataset(x, path, "/data")
    return spark.read.text(f"{path}/labels").select("split", "value")


def k14_char_file(spark, sf_dir):
    """The characters of the labels but those of the test split, and how many rows each split has."""
    path = fresh_path(spark)
    n = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(F.concat(F.lit("/im/"), n).alias("image_path"), F.when(n % 5 == 0, F.concat("p_name", F.lit("~"))).otherwise(F.col("p_name")).alias("Target"), F.when(n % 5 == 0, "test").when(n % 5 == 1, "valid").otherwise("train").alias("split"))
    writers.paddle_dataset(x, path)
    found = spark.read.text(f"{path}/characters").agg(F.array_join(F.array_sort(F.collect_list("value")), "").alias("characters"))
    return found.crossJoin(spark.read.json(f"{path}/metadata").select("n_train", "n_valid", "n_test"))  # one row each


def k06_target_files(spark, sf_dir):
    """The summary of token counts as JSON with sorted keys, beside its audit."""
    path = fresh_path(spark)
    x = audit.target_audit(manifest(spark, sf_dir), F.length("Target") + 2, 512, 256)
    writers.audit_bundle(x, audit.target_summary(x), path, [F.desc("token_count"), "ID"])
    return spark.read.json(f"{path}/summary").withColumns({c: F.round(c, 6) for c in ("min_pixels_per_char", "median_pixels_per_char")})


def s09_transcripts(spark, sf_dir):
    """A text file for each row, in folders of bounded size, and the transcripts that one folder after another gives."""
    path = fresh_path(spark)
    n = F.col("p_partkey")
    text = F.concat(F.lit("\n "), F.col("p_name"), F.lit("\r\n\t"), F.col("p_type"), F.lit("e\u0301 \n"))
    filetree.write_files(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).select(F.concat((n % 8).cast("string"), F.lit("/"), n.cast("string"), F.lit(".v1.txt")).alias("path"), F.encode(text, "UTF-8").alias("content")), path)
    return readers.transcripts(spark, f"{path}/*")


def s14_tokenizer_file(spark, sf_dir):
    """Names as ids of a tokenizer that was saved from their alphabet and loaded again."""
    path, part = fresh_path(spark), table(spark, sf_dir, "part")
    letters = audit.alphabet(part, "p_name").orderBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ch"))), lambda r: r["ch"]), "")).first()[0]
    models.save_tokenizer(spark, letters, path)
    return part.select("p_partkey", F.array_join(decoding.encode(F.col("p_name"), models.load_tokenizer(spark, path)), " ").alias("ids"))


def w01_repeated_ids(spark, sf_dir):
    return relations.repeated_ids(table(spark, sf_dir, "orders"), "o_custkey")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and k[1:3].isdigit()}
SPLIT_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"
GROUPED_SQL = catalogue.ORACLE_SQL["a07_grouped_errors"]
ORACLE_SQL = {
    "s01_manifest": "SELECT ID, width, md5(coalesce(t, '')) AS digest, length(coalesce(t, '')) AS n FROM (SELECT doc_id AS ID, doc_id / 4 AS width, CASE doc_id % 5 WHEN 0 THEN ' \"' || text || '\", said' || chr(13) || chr(10) || ' ' WHEN 1 THEN '' WHEN 2 THEN text END AS t FROM documents)",
    "s07_source_files": f"SELECT ID, source_idx, 's' || source_idx AS source, text FROM ({SOURCES_SQL})",
    "j06_same_order": catalogue.ORACLE_SQL["a11_weighted_vote"],
    "j07_grouped_shapes": GROUPED_SQL,
    "k02_row_errors": f"SELECT ID, reference, prediction, char_edits, round(char_edits / ref_char_len, 6) AS row_cer, row_number() OVER (ORDER BY char_edits / ref_char_len DESC, ID) - 1 AS place FROM {catalogue.ROWS}",
    "k03_grouped_files": f"SELECT group_name, group_value, n, mean_row_cer, mean_char_edits, row_number() OVER (ORDER BY group_name, group_value) - 1 AS place FROM ({GROUPED_SQL})",
    "k04_charset_files": "SELECT *, row_number() OVER (ORDER BY n, ch) - 1 AS place FROM (SELECT ch, count(*) AS n, count(DISTINCT p_partkey) AS n_rows FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, '')) AS ch FROM part) GROUP BY ch)",
    "k05_alignment_files": f"SELECT a.ID, ctc_margin, is_ctc_length_valid, md5(trim(regexp_replace(m.Target, '\\s+', ' ', 'g'))) AS text, row_number() OVER (ORDER BY ctc_margin, a.ID) - 1 AS place FROM {catalogue.ALIGNED} a JOIN {catalogue.MANIFEST_SQL} m ON m.ID = a.ID",
    "k10_symbol_file": "WITH a AS (SELECT ['<ctc>'] || list_sort(list_distinct(flatten(list(string_split(replace(p_name, ' ', ''), ''))))) || ['<unk>', '<space>'] AS s FROM part) SELECT s[i] AS symbol, (i - 1)::INT AS idx FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM a)",
    "k13_label_lines": f"SELECT {SPLIT_SQL} AS split, 'im/' || p_partkey || '.jpg' || chr(9) || p_name || ' ' || p_brand AS value FROM part",
    "k14_char_file": f"SELECT (SELECT string_agg(ch, '' ORDER BY ch) FROM (SELECT DISTINCT unnest(string_split(replace(p_name, ' ', ''), '')) AS ch FROM part WHERE p_partkey % 5 <> 0)) AS characters, count(*) FILTER ({SPLIT_SQL} = 'train') AS n_train, count(*) FILTER ({SPLIT_SQL} = 'valid') AS n_valid, count(*) FILTER ({SPLIT_SQL} = 'test') AS n_test FROM part",
    "k06_target_files": catalogue.ORACLE_SQL["a19_target_summary"],
    "s09_transcripts": "SELECT p_partkey || '.v1' AS ID, p_name || ' ' || p_type || chr(233) AS Target FROM part",
    "s14_tokenizer_file": "WITH a AS (SELECT list_sort(list_distinct(flatten(list(string_split(p_name, ''))))) AS s FROM part) SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ''), lambda c: list_position(s, c)), 'string_agg', ' ') AS ids FROM part, a",
    "w01_repeated_ids": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
}
