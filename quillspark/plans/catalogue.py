"""Registered queries of the transcription operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, charlm, decoding, ensemble, evaluation, images, integrity, profile, ranks, relations
from ..shared import fresh_path
from ..sources import datasets, filetree, imageheaders, manifests, readers
from ..streaming import resume

PAIRS_SQL = """(SELECT cast(p_partkey AS varchar) AS ID, p_name || ' ' || p_type || ' ' || p_brand AS reference,
 CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN p_name || ' ' || p_type || ' ' || p_brand
 WHEN p_partkey % 7 = 2 THEN replace(p_name || ' ' || p_type || ' ' || p_brand, p_type || ' ', '')
 ELSE replace(replace(p_name || ' ' || p_type || ' ' || p_brand, 'e', 'c'), '#', ' ') END AS prediction FROM part)"""
SOURCES_SQL = " UNION ALL ".join(f"""SELECT cast(p_partkey AS varchar) AS ID, {k} AS source_idx,
 CASE WHEN p_partkey % {m} = 0 THEN '' WHEN p_partkey % {m} = 1 THEN replace(p_name, 'e', 'c') WHEN p_partkey % {m} = 2 THEN p_name || '!' ELSE p_name END AS text FROM part""" for k, m in enumerate((3, 4, 5, 7, 11)))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark, sf_dir, name, text):
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text.replace("varchar", "string"))


def pairs(spark, sf_dir):
    return sql(spark, sf_dir, "part", f"SELECT * FROM {PAIRS_SQL}")


def sources(spark, sf_dir):
    return sql(spark, sf_dir, "part", SOURCES_SQL)


def manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("ID"), "doc_id", "lang", F.col("text").alias("Target"), (267 + (F.col("doc_id") * 7919) % 5785).cast("double").alias("width"), (28 + (F.col("doc_id") * 104729) % 1104).cast("double").alias("height"))


MANIFEST_SQL = "(SELECT cast(doc_id AS varchar) AS ID, doc_id, lang, text AS Target, (267 + (doc_id * 7919) % 5785)::DOUBLE AS width, (28 + (doc_id * 104729) % 1104)::DOUBLE AS height FROM documents)"


EDITS = ["char_edits", "char_insertions", "char_deletions", "char_substitutions", "word_edits", "word_insertions", "word_deletions", "word_substitutions"]


def a05_corpus_summary(spark, sf_dir):
    s = evaluation.corpus_summary(evaluation.row_errors(pairs(spark, sf_dir)))
    return s.drop(*[c for c in s.columns if c.endswith(("insertions", "deletions", "substitutions"))])


def a05_edit_totals(spark, sf_dir):
    """The totals of each kind of edit."""
    s = evaluation.corpus_summary(evaluation.row_errors(pairs(spark, sf_dir)))
    return s.select("row_count", *EDITS)


def a04_row_errors(spark, sf_dir):
    x = evaluation.row_errors(pairs(spark, sf_dir))
    sums = [F.expr(f"{u}_insertions + {u}_deletions + {u}_substitutions").alias(f"{u}_kinds") for u in ("char", "word")]
    net = [F.expr(f"{u}_insertions - {u}_deletions").alias(f"{u}_net") for u in ("char", "word")]
    return x.select("ID", "reference", "prediction", "exact_match", "ref_char_len", "pred_char_len", "ref_word_len", "pred_word_len", "char_edits", F.round("row_cer", 6).alias("row_cer"), "word_edits", F.round("row_wer", 6).alias("row_wer"), *sums, *net)


def a02_edit_counts(spark, sf_dir):
    return evaluation.edit_counts(pairs(spark, sf_dir))


def a06_confusions(spark, sf_dir):
    return evaluation.confusions(pairs(spark, sf_dir))


def a06_confusion_totals(spark, sf_dir):
    """a06's counts added up: all edits, and by how many insertions exceed deletions."""
    c = evaluation.confusions(pairs(spark, sf_dir))
    return c.agg(F.sum("n").alias("edits"), F.sum(F.when(F.col("op") == "insert", F.col("n")).when(F.col("op") == "delete", -F.col("n")).otherwise(0)).alias("net"))


def a07_grouped_errors(spark, sf_dir):
    x = evaluation.row_errors(pairs(spark, sf_dir)).withColumn("aspect_ratio", F.expr("cast(ID as double) % 30"))
    return evaluation.grouped(evaluation.slices(x))


def a08_majority_vote(spark, sf_dir):
    return ensemble.majority(sources(spark, sf_dir))


def a10_consensus(spark, sf_dir):
    return ensemble.consensus(sources(spark, sf_dir))


def a10_guarded(spark, sf_dir):
    return ensemble.consensus(sources(spark, sf_dir), 2, length_delta=3, outlier_delta=1)


def a11_weighted_vote(spark, sf_dir):
    return ensemble.weighted(sources(spark, sf_dir), {0: 2.0, 3: 1.5})


def a11_priority(spark, sf_dir):
    return ensemble.weighted(sources(spark, sf_dir), {2: 2.0}, priority=[4, 3, 1]).select("ID", "text", "chosen_source", "votes")


def a12_keep_anchor(spark, sf_dir):
    return ensemble.keep_anchor(sources(spark, sf_dir))


def a14_char_frequency(spark, sf_dir):
    return audit.char_frequency(table(spark, sf_dir, "part"), "p_name", "p_partkey")


def a17_ngram_counts(spark, sf_dir):
    return audit.ngram_counts(table(spark, sf_dir, "part"), "p_name", 3)


def a14_named_chars(spark, sf_dir):
    return audit.named_chars(audit.char_frequency(table(spark, sf_dir, "part"), "p_name", "p_partkey")).select("ch", "category", F.length("unicode_name").alias("name_len"))


def a15_rare_lines(spark, sf_dir):
    return audit.rare_lines(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t")), "t", "p_partkey", most=400).select("p_partkey", "rare_chars", "rare_char_count", "char_len")


def a16_alphabet(spark, sf_dir):
    return audit.alphabet(table(spark, sf_dir, "part"), "p_name", "^~")


def a18_ctc_summary(spark, sf_dir):
    x = audit.ctc_summary(audit.ctc_alignment(manifest(spark, sf_dir)))
    return x.withColumns({c: F.round(c, 6) for c in ("min_pixels_per_char", "median_pixels_per_char")})


def t06_round_trip(spark, sf_dir):
    return audit.round_trip(table(spark, sf_dir, "part"), "p_name", "p_partkey", " abcdefghiklmnoprstu").select("p_partkey", "encoded_length", "decoded", "roundtrip_ok", "error")


def t13_ctc_alignment(spark, sf_dir):
    x = audit.ctc_alignment(manifest(spark, sf_dir)).drop("text")
    return x.withColumn("pixels_per_char", F.round("pixels_per_char", 6))


def t14_target_audit(spark, sf_dir):
    x = audit.target_audit(manifest(spark, sf_dir), F.length("Target") + 2, 512, 256).drop("text")
    return x.withColumn("pixels_per_char", F.round("pixels_per_char", 6))


def a19_target_summary(spark, sf_dir):
    x = audit.target_summary(audit.target_audit(manifest(spark, sf_dir), F.length("Target") + 2, 512, 256))
    return x.withColumns({c: F.round(c, 6) for c in ("min_pixels_per_char", "median_pixels_per_char")})


def pictures(spark, sf_dir):
    """Grey images of 8 x 8 pixels, a number of an embedding each."""
    x = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    level = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 200)))), 2, "0"))
    return x.select(F.col("vec_id").cast("string").alias("ID"), F.when(F.col("label") % 2 == 0, "train").otherwise("test").alias("split"), F.col("label").cast("string").alias("Target"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(level, "")).alias("pixels"), F.lit(True).alias("readable"), (F.col("label") != 3).alias("exists"), F.md5(F.array_join(level, "")).alias("file_md5"))


def t21_image_quality(spark, sf_dir):
    x = images.quality(pictures(spark, sf_dir))
    return x.select("ID", "ahash", *[F.round(m, 1 if m == "sharpness_grad_var" else 4).alias(m) for m in images.METRICS])


def p13_quality_flags(spark, sf_dir):
    x = images.quality_flags(images.quality(pictures(spark, sf_dir)))
    return x.select("ID", *[c for c in x.columns if c.startswith("flag_")], "quality_flag_count")


def s18_line_rows(spark, sf_dir):
    x = pictures(spark, sf_dir).withColumn("image_path", images.image_path(F.col("ID"), "/im"))
    return images.line_rows(x.select("ID", "Target"), x, "0123456789").select("ID", "image_path", "width", F.length("pixels").alias("n_pixels"), F.array_join("target_ids", " ").alias("target_ids"))


def p03_only_fold(spark, sf_dir):
    return relations.only_fold(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("fold")), 3)


def a20_readability(spark, sf_dir):
    return images.readability(pictures(spark, sf_dir).withColumn("readable", F.col("Target").cast("int") % 5 != 0))


def t22_resized_images(spark, sf_dir):
    x = images.padded(images.scaled(pictures(spark, sf_dir), 4, most=6, cutoff=1), 6, align="center")
    return x.select("ID", "width", "height", "channels", F.length("pixels").alias("n_bytes"))


def t22_scaled_pixels(spark, sf_dir):
    """All pixels of images that were halved in both directions and padded on the left."""
    return images.padded(images.scaled(pictures(spark, sf_dir), 4), 6, align="right").select("ID", "width", "height", F.hex("pixels").alias("pixels"))


def a21_duplicate_images(spark, sf_dir):
    x = images.quality(pictures(spark, sf_dir)).withColumn("half", F.substring("ahash", 1, 2))
    return audit.duplicate_images(x, "half", "Target", 20).select("half", "n", "unique_files", "unique_labels", F.array_join("ids", ",").alias("ids"), F.size("labels").alias("n_labels"))


def w02_duplicate_members(spark, sf_dir):
    return audit.duplicate_members(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id")


def w03_once(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ID"), F.col("l_linenumber").alias("image_path"))
    return images.once(x)


def w09_batch_width(spark, sf_dir):
    x = manifest(spark, sf_dir).select("ID", "doc_id", "width")
    return images.batch_width(x, F.floor(F.col("doc_id") / 16), 32).select("ID", "batch", "padded_width")


def w10_batches(spark, sf_dir):
    return ranks.batches(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 64)


def s03_image_path(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", images.image_path(F.col("p_partkey"), "/data/images/").alias("image_path"))


def s17_window(spark, sf_dir):
    return ranks.window_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 10, 25)


def j10_manual_review(spark, sf_dir):
    m = manifest(spark, sf_dir)
    labels = profile.label_flags(profile.label_features(m.select("ID", "Target"), "Target")).withColumnRenamed("n_flags", "label_flag_count")
    shape = m.where("doc_id % 3 <> 0").select("ID", "width", "height", (F.col("width") / F.col("height")).alias("aspect_ratio"), F.length("Target").alias("char_len"))
    return integrity.manual_review(m.select("ID"), labels=labels, consistency=integrity.consistency_flags(shape)).select("ID", "label_flag_count", "consistency_flag_count", "total_flag_count")


def p14_consistency_flags(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.col("p_size").cast("double").alias("width"), F.col("p_retailprice").alias("height"), (F.col("p_size") / F.col("p_retailprice")).alias("aspect_ratio"), F.length("p_name").alias("char_len"))
    return integrity.consistency_flags(x).select("ID", F.round("pixels_per_char", 6).alias("pixels_per_char"), F.round("rz_pixels_per_char", 6).alias("rz_pixels_per_char"), F.round("residual", 4).alias("residual"), "flag_width_text_mismatch", "flag_shape_text_residual", "flag_short_label_wide_image", "flag_long_label_narrow_image", "consistency_flag_count")


def p10_holds_any(spark, sf_dir):
    return table(spark, sf_dir, "part").where(integrity.holds_any(F.col("p_name"), "qzx")).select("p_partkey")


def u05_alphabets(spark, sf_dir):
    a, b = (T.chars(F.col(c)) for c in ("p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(integrity.alphabet_union(a, b), "").alias("both"), F.array_join(integrity.collisions(a, ["a", "z", "~"]), "").alias("shared"))


def d06_output_steps(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", integrity.output_steps(F.col("p_size"), 4).alias("steps"))


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 8 + 1).cast("int").alias("steps"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, 8)).alias("logits"))


def d01_greedy_lengths(spark, sf_dir):
    return audit.greedy_decode(logits(spark, sf_dir), "logits", "ABCDEFG", "steps").select("vec_id", "text")


def d03_rerank_decode(spark, sf_dir):
    how = decoding.DecoderConfig("beam_lm_rerank", beam=5, candidates=3, penalties={"min_chars": 6, "short": 0.5})
    return decoding.decode(logits(spark, sf_dir), "logits", "ABCDEFG", how, length="steps").select("vec_id", "text", "candidates")


def o05_rare_sample(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return audit.rare_first_sample(x, integrity.holds_any(F.col("p_name"), "qz"), "p_partkey", 40)


def t12_export_width(spark, sf_dir):
    from ..sources.writers import export_height, jpg, shown_path

    x = manifest(spark, sf_dir)
    path = F.concat(F.lit("/data/im/"), "ID", F.when(F.col("doc_id") % 2 == 0, ".jpeg").otherwise(".png"))
    return x.select("ID", export_height(F.col("width"), F.col("height"), 64).alias("export_width"), shown_path(jpg(path), "/data").alias("shown"))


def w04_quantile_bins(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return audit.quantile_bins(x, "c_acctbal", 5, "c").select("c_custkey", "c_acctbal_bin")


def w06_fold_sizes(spark, sf_dir):
    return ranks.stratified_folds(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 5).groupBy("c_mktsegment", "fold").agg(F.count("*").alias("n"))


def a21_duplicate_groups(spark, sf_dir):
    return audit.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


def a22_robust_z(spark, sf_dir):
    return audit.robust_z(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))


def t01_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_text(F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_type"), lower=True, remove_punctuation=True).alias("text"))


def t07_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.tokenize(F.col("p_name")).alias("tokens"), T.detokenize(T.tokenize(F.col("p_name"))).alias("text"))


def d01_greedy_decode(spark, sf_dir):
    x = logits(spark, sf_dir)
    return audit.greedy_decode(x, "logits", "ABCDEFG").select("vec_id", "text")


def a13_source_scores(spark, sf_dir):
    truth = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("reference"))
    return relations.source_scores(sources(spark, sf_dir), truth)


def a19_token_summary(spark, sf_dir):
    x = table(spark, sf_dir, "part")
    return profile.token_summary(profile.token_audit(x, F.length("p_name") + 2, 16))


def a23_residuals(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return profile.residuals(x, "p_retailprice", ["p_size"]).select("p_partkey", F.round("residual", 4).alias("residual"))


def a24_overview(spark, sf_dir):
    return profile.overview(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).withColumn("missing_pct", F.round("missing_pct", 9))


def a25_describe(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "customer"), "c_acctbal")


def a25_correlations(spark, sf_dir):
    return profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


LABELS_SQL = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN p_brand || '!!' WHEN 3 THEN '((' || p_type || ')) \"\" ' || p_name WHEN 4 THEN p_name || ', ' || p_name || ';' ELSE '--' || p_name END AS label FROM part)"


def labels(spark, sf_dir):
    """Labels with brackets, quotes, repeated marks, repeated and missing values."""
    return sql(spark, sf_dir, "part", f"SELECT * FROM {LABELS_SQL}")


def a26_top_words(spark, sf_dir):
    return profile.top_words(labels(spark, sf_dir), "label", 20)


def a26_all_words(spark, sf_dir):
    return profile.top_words(labels(spark, sf_dir), "label", None)


def a26_top_chars(spark, sf_dir):
    return profile.top_chars(labels(spark, sf_dir), "label", 50)


def a26_top_targets(spark, sf_dir):
    return profile.top_targets(labels(spark, sf_dir), "label", 30)


def a27_label_integrity(spark, sf_dir):
    return profile.label_integrity(labels(spark, sf_dir), "label")


def a27_id_integrity(spark, sf_dir):
    return profile.id_integrity(table(spark, sf_dir, "orders"), "o_custkey")


def t19_categories(spark, sf_dir):
    x = labels(spark, sf_dir).select("p_partkey", F.explode(profile.category_counts(F.coalesce("label", F.lit("")))))
    return x.groupBy(F.col("key").alias("category")).agg(F.sum("value").alias("n"), F.count("*").alias("n_rows"))


def p12_repeats(spark, sf_dir):
    """All flags and features of labels that hold repeats of each kind."""
    x = profile.label_flags(profile.label_features(labels(spark, sf_dir), "label"))
    return x.select("p_partkey", "max_run", "repeated_marks", F.round("punct_ratio", 6).alias("punct_ratio"), *[c for c in x.columns if c.startswith("flag_")], "n_flags")


def u03_overlap(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k"))
    return relations.id_difference(c, o, "k", overlap=True).groupBy("side").agg(F.count("*").alias("n"))


def w10_line_batches(spark, sf_dir):
    """Batches over a table of many partitions, in the order of two columns."""
    return ranks.batches(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 1000)


def o03_late_window(spark, sf_dir):
    return ranks.window_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 3000)


def w04_exact_quantiles(spark, sf_dir):
    """Ranks of three columns by the same passes."""
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    q = ranks.quantiles(table(spark, sf_dir, "lineitem"), {c: shares for c in ("l_extendedprice", "l_quantity", "l_discount")})
    return spark.createDataFrame([(c, s, v) for c, own in q.items() for s, v in zip(shares, own)], "name string, share double, value double").withColumn("value", F.round("value", 6))


def line_manifests(spark, sf_dir):
    """Images with labels as texts and five folds, and those without."""
    x = pictures(spark, sf_dir).select("ID", F.concat(F.lit(" label  "), "Target", F.lit(" (x)")).alias("Target"), F.expr("cast(ID as int) % 6").alias("fold"), "width", "height", "channels", "pixels")
    return x.where("fold < 5"), x.where("fold = 5").drop("Target", "fold")


def k12_line_files(spark, sf_dir):
    """Images and truth written as files, then read back: sizes from headers, truth from its files."""
    path = fresh_path(spark)
    datasets.kraken_dataset(*line_manifests(spark, sf_dir), path, fold=1, height=16, fanout=8)
    split = F.element_at(F.split("image_path", "/"), -3)
    images_ = imageheaders.sizes(spark, path, "*.png").select("ID", split.alias("split"), "width", "height", "mode")
    truth = filetree.whole_texts(spark, f"{path}/*/*", "*.gt.txt").select(F.regexp_extract("name", r"^(.*)\.gt\.txt$", 1).alias("own"), F.col("value").alias("truth"))
    return images_.join(truth, F.col("ID") == F.col("own"), "left").drop("own")


def k11_tables(spark, sf_dir):
    """The tables of a data set as lines of their files."""
    path = fresh_path(spark)
    datasets.pylaia_dataset(*line_manifests(spark, sf_dir), path, fold=1, height=16)
    return spark.read.text(path, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def t15_model_scores(spark, sf_dir):
    """Names by a model of order 3 that was learned from them, counted, written and mapped back."""
    path, part = fresh_path(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    charlm.train(part, "p_name", path, 3, 0.5, extra="^~")
    return charlm.scores(part, "p_name", charlm.load(spark, path)).select("p_partkey", "steps", F.round("log_prob", 6).alias("log_prob"))


def d02_model_search(spark, sf_dir):
    """Beam search with a language model in its scores."""
    path, x = fresh_path(spark), logits(spark, sf_dir)
    charlm.train(audit.greedy_decode(x, "logits", "ABCDEFG"), "text", path, 3)
    lm = charlm.load(spark, path)
    return decoding.beam_decode(x, "logits", "ABCDEFG", candidates=3, beam=10, lm=lm, lm_weight=0.3).select("vec_id", decoding.payload(F.col("candidates")).alias("candidates"))


def j02_aligned_pairs(spark, sf_dir):
    x = pairs(spark, sf_dir)
    return evaluation.align(x.select("ID", F.col("reference").alias("Target")), x.select("ID", F.col("prediction").alias("Target")))


def j03_aligned_subset(spark, sf_dir):
    x = pairs(spark, sf_dir)
    return evaluation.align(x.select("ID", F.col("reference").alias("Target")), x.where("cast(ID as long) % 3 = 0").select("ID", F.col("prediction").alias("Target")), subset=True)


def j05_stacked(spark, sf_dir):
    """Checked and stacked: five sources of one set of IDs."""
    x = sources(spark, sf_dir)
    own = {f"s{k}": x.where(F.col("source_idx") == k).select("ID", F.col("text").alias("Target")) for k in range(5)}
    ensemble.require_same_ids(own["s0"], {k: v for k, v in own.items() if k != "s0"})
    return ensemble.stacked(own)


def p03_stored_fold(spark, sf_dir):
    """A fold of a stored manifest with the rows of another stored table, joined by buckets."""
    tag = fresh_path(spark).rsplit("-", 1)[-1]
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_orderkey").alias("ID"), (F.col("o_orderkey") % 5).alias("fold"), "o_orderpriority")
    manifests.store(lines, f"lines_{tag}", fresh_path(spark), 8)
    files = manifests.store(o.select(F.col("o_orderkey").alias("ID"), F.concat(F.lit("/im/"), "o_orderkey").alias("image_path")), f"files_{tag}", fresh_path(spark), 8, fold=None)
    return relations.attach(manifests.load(spark, f"lines_{tag}", fold=2), files, "ID", "image_path")


def w11_resumed_work(spark, sf_dir):
    """Transcripts normalised by a run that stops after two waves of five and by one that goes on from there."""
    todo = table(spark, sf_dir, "documents").select("doc_id", "text")
    run = resume.Resumable(spark, fresh_path(spark), "doc_id", "doc_id long, n long, digest string")
    work = lambda x: x.select("doc_id", F.length(T.normalize_text(F.col("text"))).cast("long").alias("n"), F.md5(T.normalize_text(F.col("text"))).alias("digest"))
    run.run(todo, work, waves=5, most=2)
    return run.run(todo, work, waves=2)


def a29_best_epoch(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))
    return relations.best_epoch(x)


def d02_beam_search(spark, sf_dir):
    x = logits(spark, sf_dir)
    return decoding.beam_decode(x, "logits", "ABCDEFG", candidates=3, beam=10).select("vec_id", decoding.payload(F.col("candidates")).alias("candidates"))


def j09_submission(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relations.submission(o.select("o_custkey").distinct(), o, "o_custkey", "o_orderpriority", "o_orderkey")


def o04_overfit_sample(spark, sf_dir):
    return relations.overfit_sample(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 32)


def p02_fold_split(spark, sf_dir):
    x = table(spark, sf_dir, "part").withColumn("fold", F.col("p_partkey") % 5)
    return relations.split_fold(x, 2).groupBy("split").agg(F.count("*").alias("n"))


def p11_label_features(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("é"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit("  "), "p_brand", F.lit("!!"))).alias("Target"))
    return profile.label_features(x, "Target").select("p_partkey", "char_len", F.col("word_len").cast("long").alias("word_len"), "edge_space", "repeated_space", "empty", F.round("digit_ratio", 6).alias("digit_ratio"), F.round("alpha_ratio", 6).alias("alpha_ratio"), "non_ascii")


def p12_label_flags(spark, sf_dir):
    x = manifest(spark, sf_dir).select("ID", "Target")
    return profile.label_flags(profile.label_features(x, "Target")).select("ID", "max_run", "n_flags", "flag_repeated_chars", "flag_repeated_marks")


def s10_decoder_lines(spark, sf_dir):
    x = table(spark, sf_dir, "part").select(F.concat(F.lit("test/a/"), F.col("p_partkey").cast("string"), F.lit(".v1.jpg "), T.tokenize(F.col("p_name"))).alias("value"))
    return readers.decoder_lines(x, "test/")


def s12_path_lines(spark, sf_dir):
    p = F.col("p_partkey")
    payload = F.when(p % 3 == 0, F.col("p_name")).when(p % 3 == 1, F.concat(F.lit("[('"), "p_name", F.lit("', 0.99)]"))).otherwise(F.concat(F.lit('{"text": "'), "p_name", F.lit('"}')))
    return readers.path_lines(table(spark, sf_dir, "part").select(F.concat(F.lit("/tmp/"), p.cast("string"), F.lit(".jpg\t"), payload).alias("value")))


def t03_unicode_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unicode_form(F.col("text"))).alias("digest"))


def t04_encode(spark, sf_dir):
    x = F.lower("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(decoding.encode(x, "abcdefghijklm ", strict=False), " ").alias("ids"), F.array_join(decoding.unknown(x, "abcdefghijklm "), "").alias("unknown"))


def t16_rerank_score(spark, sf_dir):
    t = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "!!").when(F.col("p_partkey") % 3 == 1, "  x ").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(decoding.reranked_score(t, F.col("p_retailprice"), 20, 0.5, 1.0, 2.0, 4.0), 6).alias("score"))


def u02_id_difference(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("k"))
    return relations.id_difference(c, o, "k")


def w05_coarsen(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("label"), "p_brand")
    return relations.coarsen(x, "label", 3, F.col("p_brand")).select("p_partkey", "label")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[:3].rstrip("0123456789") in tuple("spjawotduk") and k[1:3].isdigit()}
NORMAL = f"(SELECT ID, trim(regexp_replace(reference, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(prediction, '\\s+', ' ', 'g')) AS p FROM {PAIRS_SQL})"
WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
#: Words as characters of one byte, which levenshtein counts; a row has few words.
CODED = f"(SELECT *, list_distinct(rw || pw) AS known FROM (SELECT *, {WORDS.format('r')} AS rw, {WORDS.format('p')} AS pw FROM {NORMAL}))"
CODE = "coalesce(list_aggregate(list_transform({}, lambda w: chr(32 + list_position(known, w)::INT)), 'string_agg', ''), '')"
ROWS = f"""(SELECT *, CASE WHEN ref_word_len > 0 THEN round(word_edits / ref_word_len, 6) WHEN word_edits = 0 THEN 0 ELSE 1 END AS row_wer FROM
 (SELECT ID, r AS reference, p AS prediction, r = p AS exact_match, length(r) AS ref_char_len, length(p) AS pred_char_len, len(rw) AS ref_word_len, len(pw) AS pred_word_len, levenshtein(r, p)::BIGINT AS char_edits, round(levenshtein(r, p) / length(r), 6) AS row_cer,
 levenshtein({CODE.format('rw')}, {CODE.format('pw')})::BIGINT AS word_edits FROM {CODED}))"""
TOKENS = f"(SELECT ID, list_filter(string_split(r, ''), lambda c: c <> '') AS rc, list_filter(string_split(p, ''), lambda c: c <> '') AS pc, rw, pw FROM {CODED})"


def steps_sql(name, x, y):
    """A recursive table name(ID, o) of each row's steps that aren't matches: the edit table of lists x and y by its
    diagonals, ties by match, substitute, delete, insert; a and b are the last two diagonals, by place in x."""
    cell = "NULL::STRUCT(c INT, o VARCHAR[])"
    return f"""{name}_w(ID, n, m, x, y, d, a, b) AS (
 SELECT ID, len({x}), len({y}), {x}, {y}, 0, list_transform(range(0, len({x}) + 1), lambda k: {cell}), list_transform(range(0, len({x}) + 1), lambda k: CASE k WHEN 0 THEN {{'c': 0, 'o': []::VARCHAR[]}} END) FROM {TOKENS}
 UNION ALL
 SELECT ID, n, m, x, y, d + 1, b, list_transform(range(0, n + 1), lambda k: CASE WHEN k > d + 1 OR d + 1 - k > m THEN NULL
  WHEN k > 0 AND k <= d AND x[k] = y[d + 1 - k] AND a[k].c <= least(b[k].c + 1, b[k + 1].c + 1) THEN a[k]
  WHEN k > 0 AND k <= d AND a[k].c <= least(b[k].c, b[k + 1].c) THEN {{'c': a[k].c + 1, 'o': list_append(a[k].o, 'substitute' || chr(1) || x[k] || chr(1) || y[d + 1 - k])}}
  WHEN k > 0 AND (k > d OR b[k].c <= b[k + 1].c) THEN {{'c': b[k].c + 1, 'o': list_append(b[k].o, 'delete' || chr(1) || x[k] || chr(1))}}
  ELSE {{'c': b[k + 1].c + 1, 'o': list_append(b[k + 1].o, 'insert' || chr(1) || chr(1) || y[d + 1 - k])}} END) FROM {name}_w WHERE d < n + m),
 {name} AS (SELECT ID, b[n + 1].o AS o FROM {name}_w WHERE d = n + m)"""


def kinds_sql(name, of="{}"):
    return ", ".join(f"{of.format(f'len(list_filter({name}.o, lambda s: starts_with(s, {chr(39)}{k}{chr(39)})))')}::BIGINT AS {n}" for k, n in (("insert", "insertions"), ("delete", "deletions"), ("substitute", "substitutions")))


GEOMETRY = f"""(SELECT *, greatest(1, floor(resized_width / 4))::BIGINT AS encoder_time_steps, length(t) AS target_length, length(t) - length(regexp_replace(t, '(?s)(.)x', '', 'g')) AS unused FROM
 (SELECT ID, width AS original_width, height AS original_height, trim(regexp_replace(Target, '\\s+', ' ', 'g')) AS t, least(greatest(1, round_even(width * (96.0::DOUBLE / height), 0)), 2048)::BIGINT AS resized_width, greatest(1, round_even(width * (96.0::DOUBLE / height), 0))::BIGINT AS unclipped_resized_width FROM {MANIFEST_SQL}))"""
ALIGNED = f"""(SELECT *, target_length + adjacent_repeat_count AS required_ctc_steps, encoder_time_steps - target_length - adjacent_repeat_count AS ctc_margin, encoder_time_steps >= target_length + adjacent_repeat_count AS is_ctc_length_valid, round(resized_width / greatest(target_length, 1), 6) AS pixels_per_char FROM
 (SELECT g.* EXCLUDE (t, unused), resized_width < unclipped_resized_width AS was_width_clipped, coalesce(len(list_filter(list_zip(string_split(t, ''), string_split(substr(t, 2), '')), lambda z: z[1] = z[2])), 0)::BIGINT AS adjacent_repeat_count FROM {GEOMETRY} g))"""
AUDIT = f"""(SELECT ID, length(Target) + 2 AS token_count, width AS original_width, height AS original_height, least(greatest(1, u), 384)::BIGINT AS aspect_resized_width, greatest(1, u)::BIGINT AS unclipped_aspect_resized_width, length(t) AS char_len, len({WORDS.format('t')}) AS word_len, length(Target) + 2 > 512 AS exceeds_max_label_length, length(Target) + 2 > 256 AS exceeds_max_generation_length, greatest(1, u) > 384 AS would_clip_aspect_canvas, round(least(greatest(1, u), 384) / greatest(length(t), 1), 6) AS pixels_per_char FROM
 (SELECT *, trim(regexp_replace(Target, '\\s+', ' ', 'g')) AS t, round_even(width * (384.0::DOUBLE / height), 0) AS u FROM {MANIFEST_SQL}))"""
PICTURES = """(SELECT vec_id, label, cast(vec_id AS varchar) AS ID, list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * 400 + 200)))) AS g FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"""
QUALITY = f"""(SELECT *, list_avg(g) AS brightness_mean, list_median(g) AS brightness_median, list_stddev_pop(g) AS contrast_std, list_aggregate(g, 'quantile_cont', 0.01) AS p01, list_aggregate(g, 'quantile_cont', 0.99) AS p99,
 list_aggregate(list_transform(range(0, 64), lambda q: pow((g[q + 1 + (q % 8 < 7)::INT] - g[q + 1 - (q % 8 > 0)::INT]) / ((q % 8 < 7)::INT + (q % 8 > 0)::INT), 2) + pow((g[q + 1 + 8 * (q < 56)::INT] - g[q + 1 - 8 * (q > 7)::INT]) / ((q < 56)::INT + (q > 7)::INT), 2)), 'var_pop') AS sharpness_grad_var,
 len(list_filter(g, lambda x: x < 80)) / 64 AS dark_pixel_ratio, len(list_filter(g, lambda x: x > 245)) / 64 AS bright_pixel_ratio, len(list_filter(g, lambda x: x < 245)) / 64 AS foreground_ratio,
 len(list_filter(g[1:16], lambda x: x < 220)) / 16 AS top_foreground_ratio, len(list_filter(g[49:64], lambda x: x < 220)) / 16 AS bottom_foreground_ratio, len(list_filter(g, lambda x, i: x < 220 AND (i - 1) % 8 < 2)) / 16 AS left_foreground_ratio, len(list_filter(g, lambda x, i: x < 220 AND (i - 1) % 8 > 5)) / 16 AS right_foreground_ratio FROM {PICTURES})"""
AHASH = "(SELECT ID, list_aggregate(list_transform(range(1, 65, 4), lambda i: substr('0123456789abcdef', (8 * (g[i] > m)::INT + 4 * (g[i + 1] > m)::INT + 2 * (g[i + 2] > m)::INT + (g[i + 3] > m)::INT + 1)::INT, 1)), 'string_agg', '') AS ahash FROM (SELECT *, list_avg(g) AS m FROM " + PICTURES + "))"
CANDIDATES = f"(SELECT ID, source_idx, cast(source_idx AS varchar) AS source, text FROM ({SOURCES_SQL}))"


def consensus_sql(least, guards):
    return f"""WITH s AS (SELECT * FROM {CANDIDATES}), f AS (SELECT * FROM s WHERE source_idx > 0 AND trim(text) <> ''),
 v AS (SELECT ID, text, count(*) AS votes, min(source_idx) AS i, string_agg(source, '+' ORDER BY source_idx) AS who FROM f GROUP BY ID, text),
 b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ID ORDER BY votes DESC, i) = 1), m AS (SELECT ID, count(*) AS candidates, median(length(text))::DOUBLE AS median_len FROM f GROUP BY ID),
 x AS (SELECT s.ID, s.text AS anchor_text, coalesce(b.text, '') AS top_text, b.who, coalesce(b.votes, 0)::BIGINT AS votes, coalesce(candidates, 0)::BIGINT AS candidates, coalesce(median_len, length(s.text))::DOUBLE AS median_len, s.source FROM s LEFT JOIN b ON b.ID = s.ID LEFT JOIN m ON m.ID = s.ID WHERE source_idx = 0),
 y AS (SELECT *, votes >= {least} AND top_text <> anchor_text {guards} AS ok FROM x)
 SELECT ID, anchor_text, CASE WHEN ok THEN top_text ELSE anchor_text END AS text, CASE WHEN ok THEN who ELSE source END AS chosen_source, CASE WHEN ok THEN 'consensus_replace' ELSE 'anchor' END AS strategy, ok AS changed, top_text, votes, candidates, length(anchor_text) AS anchor_len, CASE WHEN ok THEN length(top_text) ELSE length(anchor_text) END AS chosen_len, median_len, CASE WHEN ok THEN length(top_text) - length(anchor_text) ELSE 0 END AS len_change FROM y"""


def vote_sql(weight, rank):
    return f"""WITH s AS (SELECT * FROM {CANDIDATES}), f AS (SELECT * FROM s WHERE trim(text) <> ''),
 v AS (SELECT ID, text, sum({weight})::DOUBLE AS score, min({rank}) AS r, min(source_idx) AS i, string_agg(source, '+' ORDER BY source_idx) AS who FROM f GROUP BY ID, text),
 b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ID ORDER BY score DESC, r, i) = 1), m AS (SELECT ID, count(*) AS candidates, median(length(text))::DOUBLE AS median_len FROM s GROUP BY ID)
 SELECT s.ID, s.text AS anchor_text, coalesce(b.text, s.text) AS text, coalesce(b.who, s.source) AS chosen_source, 'weighted_vote' AS strategy, coalesce(b.text, s.text) <> s.text AS changed, coalesce(b.text, s.text) AS top_text, coalesce(b.score, 0)::DOUBLE AS votes, candidates, length(s.text) AS anchor_len, length(coalesce(b.text, s.text)) AS chosen_len, median_len, length(coalesce(b.text, s.text)) - length(s.text) AS len_change FROM s LEFT JOIN b ON b.ID = s.ID JOIN m ON m.ID = s.ID WHERE s.source_idx = 0"""


CONSISTENCY = ("flag_width_text_mismatch", "flag_shape_text_residual", "flag_short_label_wide_image", "flag_long_label_narrow_image")


def consistency_sql(source):
    """Tables that end with c, P-14 of a query (ID, width, height, aspect_ratio, char_len). Least squares by taking each
    regressor out of the later ones and of the length."""
    off = lambda y, x: f"{y} - regr_intercept({y}, {x}) OVER () - regr_slope({y}, {x}) OVER () * {x}"
    z = lambda v, m: f"CASE WHEN mad_{m} = 0 THEN 0 ELSE 0.6745 * ({v} - med_{m}) / mad_{m} END"
    flags = ("abs(rz_pixels_per_char) > 4", "abs(rz_residual) > 4", "char_len <= n5 AND width >= w95", "char_len >= n95 AND width <= w5")
    return f"""c0 AS ({source}), c1 AS (SELECT *, {off('height', 'width')} AS h1, {off('aspect_ratio', 'width')} AS a1, {off('char_len', 'width')} AS y1 FROM c0), c2 AS (SELECT *, {off('a1', 'h1')} AS a2, {off('y1', 'h1')} AS y2 FROM c1),
 c3 AS (SELECT ID, width, char_len, width / CASE WHEN char_len <> 0 THEN char_len END AS pixels_per_char, {off('y2', 'a2')} AS residual FROM c2),
 cm AS (SELECT median(pixels_per_char) AS med_p, median(residual) AS med_r, quantile_cont(char_len, 0.05) AS n5, quantile_cont(char_len, 0.95) AS n95, quantile_cont(width, 0.05) AS w5, quantile_cont(width, 0.95) AS w95 FROM c3), cd AS (SELECT median(abs(pixels_per_char - med_p)) AS mad_p, median(abs(residual - med_r)) AS mad_r FROM c3, cm),
 c4 AS (SELECT *, {z('pixels_per_char', 'p')} AS rz_pixels_per_char, {z('residual', 'r')} AS rz_residual FROM c3, cm, cd), c AS (SELECT *, {' + '.join(f'{k}::INT' for k in CONSISTENCY)} AS consistency_flag_count FROM (SELECT *, {', '.join(f'coalesce({f}, false) AS {k}' for f, k in zip(flags, CONSISTENCY))} FROM c4))"""


def label_flags_sql(source):
    """Tables that end with l, P-12 of (ID, Target): the longest run of a character, repeated punctuation, the number of flags."""
    return f"""l0 AS (SELECT ID, coalesce(Target, '') AS raw, trim(regexp_replace(coalesce(Target, ''), '\\s+', ' ', 'g')) AS t FROM {source}), lq AS (SELECT quantile_cont(length(t), 0.01) AS lo, quantile_cont(length(t), 0.99) AS hi FROM l0),
 lr AS (SELECT ID, max(n) AS run, bool_or(n > 1 AND regexp_matches(ch, '\\p{{P}}')) AS marks FROM (SELECT ID, ch, spot - k AS island, count(*) AS n FROM (SELECT ID, ch, spot, row_number() OVER (PARTITION BY ID, ch ORDER BY spot) AS k FROM (SELECT ID, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS spot FROM l0)) GROUP BY ALL) GROUP BY ID),
 l1 AS (SELECT l0.ID, raw, t, lo, hi, CASE WHEN t = '' THEN 1 ELSE run END::INT AS max_run, t <> '' AND marks AS repeated_marks FROM l0 JOIN lr ON lr.ID = l0.ID, lq),
 l AS (SELECT *, (t = '')::INT + regexp_matches(raw, '^\\s|\\s$|\\s\\s')::INT + regexp_matches(t, '\\p{{C}}')::INT + regexp_matches(t, '[^\\x00-\\x7F]')::INT + (length(t) <= lo)::INT + (length(t) >= hi)::INT + (length(regexp_replace(t, '\\P{{L}}', '', 'g')) / greatest(length(t), 1) < 0.55)::INT + (max_run >= 4)::INT + repeated_marks::INT AS n_flags FROM l1)"""


LINES_SQL = "(SELECT cast(vec_id AS varchar) AS ID, CASE vec_id % 6 WHEN 5 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, 'label ' || label || ' (x)' AS t FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"
MODEL = f"""p AS (SELECT ['<s>', '<s>'] || string_split(p_name, '') || ['</s>'] AS p, p_partkey FROM part), g AS (SELECT p_partkey, p[k] || '|' || p[k + 1] AS c, p[k + 2] AS t FROM (SELECT *, unnest(range(1, len(p) - 1)) AS k FROM p)), n AS (SELECT c, t, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT c, sum(n) AS m FROM n GROUP BY c), v AS (SELECT count(DISTINCT t) + 2 AS v FROM g)"""


#: Halving eight pixels by a triangle that reaches two of them: for each of four, where it begins and its weights in 2^22ths.
HALVES = "[0, 1, 3, 5] AS o, [[w / 7 * 3, w / 7 * 3, w / 7, 0], [w / 8, w / 8 * 3, w / 8 * 3, w / 8], [w / 8, w / 8 * 3, w / 8 * 3, w / 8], [w / 7, w / 7 * 3, w / 7 * 3, 0]] AS f"
HALVED = "list_transform(range(0, {n}), lambda p: least(255, floor((list_sum(list_transform(range(0, 4), lambda k: round(f[{at} + 1][k + 1]) * coalesce({x}[{place} + 1], 0))) + 2097152) / 4194304)))"
ORACLE_SQL = {
    "t22_scaled_pixels": "WITH g AS (SELECT ID, g, " + HALVES + f" FROM (SELECT *, 4194304::DOUBLE AS w FROM {PICTURES})), a AS (SELECT ID, o, f, " + HALVED.format(n=32, at="p % 4", x="g", place="(p // 4 * 8 + o[p % 4 + 1] + k)") + " AS a FROM g), b AS (SELECT ID, " + HALVED.format(n=16, at="p // 4", x="a", place="((o[p // 4 + 1] + k) * 4 + p % 4)") + """ AS b FROM a)
 SELECT ID, 6 AS width, 4 AS height, list_aggregate(list_transform(range(0, 16), lambda p: CASE p % 4 WHEN 0 THEN repeat('FFFFFF', 2) ELSE '' END || repeat(format('{:02X}', b[p + 1]::INT), 3)), 'string_agg', '') AS pixels FROM b""",
    # names of small letters are all as long as LATIN SMALL LETTER A; these texts hold no other characters but spaces
    "a14_named_chars": "SELECT ch, CASE ch WHEN ' ' THEN 'Zs' ELSE 'Ll' END AS category, CASE ch WHEN ' ' THEN 5 ELSE 20 END AS name_len FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part)",
    "a02_edit_counts": f"WITH RECURSIVE {steps_sql('e', 'rc', 'pc')} SELECT ID, {kinds_sql('e')} FROM e",
    "a05_edit_totals": f"WITH RECURSIVE {steps_sql('c', 'rc', 'pc')}, {steps_sql('w', 'rw', 'pw')} SELECT count(*) AS row_count, " + ", ".join(f"sum(len({u}.o))::BIGINT AS {n}_edits, " + kinds_sql(u, "sum({})").replace("AS ", f"AS {n}_") for u, n in (("c", "char"), ("w", "word"))) + " FROM c JOIN w ON w.ID = c.ID",
    "a06_confusions": f"WITH RECURSIVE {steps_sql('e', 'rc', 'pc')} SELECT split_part(s, chr(1), 1) AS op, split_part(s, chr(1), 2) AS ref_char, split_part(s, chr(1), 3) AS pred_char, count(*) AS n FROM (SELECT unnest(o) AS s FROM e) GROUP BY ALL",
    "k12_line_files": f"SELECT ID, split, 16 AS width, 16 AS height, 'L' AS mode, CASE WHEN split <> 'test' THEN t || chr(10) END AS truth FROM {LINES_SQL}",
    "k11_tables": f"""WITH l AS (SELECT *, split || '/' || ID AS name, list_aggregate(list_transform(string_split(t, ''), lambda c: CASE c WHEN ' ' THEN '<space>' ELSE c END), 'string_agg', ' ') AS symbols FROM {LINES_SQL}),
 a AS (SELECT list_sort(list_distinct(flatten(list(string_split(replace(t, ' ', ''), ''))))) AS a FROM l WHERE split <> 'test'), s AS (SELECT ['<ctc>'] || a || ['<unk>', '<space>'] AS s FROM a)
 SELECT split || '.txt' AS file, name || CASE split WHEN 'test' THEN '' ELSE ' ' || symbols END AS line FROM l UNION ALL SELECT split || '_text.txt', name || CASE split WHEN 'test' THEN '' ELSE ' ' || t END FROM l UNION ALL SELECT split || '_ids.txt', name FROM l UNION ALL SELECT 'syms.txt', s[i] || ' ' || (i - 1) FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "t15_model_scores": f"WITH {MODEL} SELECT p_partkey, count(*) AS steps, round(sum(ln((n + 0.5) / (m + 0.5 * v))), 6) AS log_prob FROM g JOIN n ON n.c = g.c AND n.t = g.t JOIN m ON m.c = g.c, v GROUP BY p_partkey",
    "j02_aligned_pairs": f"SELECT * FROM {PAIRS_SQL}",
    "j03_aligned_subset": f"SELECT * FROM {PAIRS_SQL} WHERE ID::BIGINT % 3 = 0",
    "j05_stacked": f"SELECT ID, source_idx, 's' || source_idx AS source, text FROM ({SOURCES_SQL})",
    "p03_stored_fold": "SELECT o_orderkey AS ID, o_orderpriority, o_orderkey % 5 AS fold, '/im/' || o_orderkey AS image_path FROM orders WHERE o_orderkey % 5 = 2",
    "a04_row_errors": f"SELECT *, char_edits AS char_kinds, word_edits AS word_kinds, pred_char_len - ref_char_len AS char_net, pred_word_len - ref_word_len AS word_net FROM {ROWS}",
    "a05_corpus_summary": f"SELECT *, round(0.5 * ue / ur + 0.5 * char_edits / ref_chars, 6) AS score FROM (SELECT count(*) AS row_count, sum(exact_match::INT)::BIGINT AS exact_rows, round(avg(exact_match::INT), 6) AS exact_rate, sum(char_edits)::BIGINT AS char_edits, sum(ref_char_len)::BIGINT AS ref_chars, sum(word_edits)::BIGINT AS word_edits, sum(ref_word_len)::BIGINT AS ref_words, round(avg(char_edits / ref_char_len), 6) AS mean_row_cer, round(avg(word_edits / ref_word_len), 6) AS mean_row_wer, round(sum(char_edits) / sum(ref_char_len), 6) AS cer, round(sum(word_edits) / sum(ref_word_len), 6) AS wer, sum(word_edits) AS ue, sum(ref_word_len) AS ur FROM {ROWS})".replace("SELECT *, round(0.5", "SELECT * EXCLUDE (ue, ur), round(0.5", 1),
    "a06_confusion_totals": f"SELECT sum(char_edits)::BIGINT AS edits, sum(pred_char_len - ref_char_len)::BIGINT AS net FROM {ROWS}",
    "a07_grouped_errors": f"""WITH g AS (SELECT *, CASE WHEN ref_char_len <= 39 THEN 'short' WHEN ref_char_len <= 80 THEN 'medium' ELSE 'long' END AS length_group, regexp_matches(reference, '[\\^*#|\\\\]') AS has_rare_symbol, length(regexp_replace(reference, '[^!-/:-@\\[-`{{-~]', '', 'g')) / length(reference) >= 0.08 AS punctuation_heavy, length(regexp_replace(reference, '[^0-9]', '', 'g')) / length(reference) >= 0.08 AS digit_heavy, pred_char_len < ref_char_len AS prediction_shorter, pred_char_len > ref_char_len AS prediction_longer, CASE WHEN ID::BIGINT % 30 <= 12 THEN 'low_ar' WHEN ID::BIGINT % 30 <= 22 THEN 'mid_ar' ELSE 'high_ar' END AS aspect_group FROM {ROWS})
 """ + " UNION ALL ".join(f"SELECT '{k}' AS group_name, cast({k} AS varchar) AS group_value, count(*) AS n, round(avg(char_edits / ref_char_len), 6) AS mean_row_cer, round(avg(word_edits / ref_word_len), 6) AS mean_row_wer, round(avg(exact_match::INT), 6) AS exact_match_rate, round(avg(char_edits), 6) AS mean_char_edits FROM g GROUP BY {k}" for k in evaluation.GROUPS),
    "a10_consensus": consensus_sql(3, ""),
    "a10_guarded": consensus_sql(2, "AND abs(length(top_text) - length(anchor_text)) <= 3 AND abs(length(anchor_text) - median_len) >= 1"),
    "a11_weighted_vote": vote_sql("CASE source_idx WHEN 0 THEN 2.0 WHEN 3 THEN 1.5 ELSE 1.0 END", "source_idx"),
    "a11_priority": "SELECT ID, text, chosen_source, votes FROM (" + vote_sql("CASE source_idx WHEN 2 THEN 2.0 ELSE 1.0 END", "CASE source_idx WHEN 4 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END") + ")",
    "a12_keep_anchor": f"SELECT ID, text AS anchor_text, text, source AS chosen_source, 'anchor' AS strategy, false AS changed, 0::BIGINT AS votes, 0::BIGINT AS candidates, length(text) AS anchor_len, length(text) AS chosen_len FROM {CANDIDATES} WHERE source_idx = 0",
    "a15_rare_lines": "WITH t AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part), c AS (SELECT p_partkey, t, unnest(string_split(t, '')) AS ch FROM t), r AS (SELECT ch FROM c GROUP BY ch HAVING count(*) <= 400) SELECT p_partkey, string_agg(DISTINCT ch, '' ORDER BY ch) AS rare_chars, count(*) AS rare_char_count, length(any_value(t)) AS char_len FROM c WHERE ch IN (SELECT ch FROM r) GROUP BY p_partkey",
    "a16_alphabet": "SELECT ch, row_number() OVER (ORDER BY ch) AS idx FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part UNION SELECT unnest(['^', '~']))",
    "a17_ngram_counts": "WITH c AS (SELECT ['<s>', '<s>'] || string_split(p_name, '') || ['</s>'] AS p FROM part), g AS (SELECT p, unnest(range(1, len(p) - 1)) AS k FROM c) SELECT p[k] || p[k + 1] AS context, p[k + 2] AS token, count(*) AS n FROM g GROUP BY ALL",
    "a18_ctc_summary": f"SELECT count(*) AS n, count(*) FILTER (NOT is_ctc_length_valid) AS invalid_rows, count(*) FILTER (was_width_clipped) AS width_clipped_rows, min(ctc_margin) AS min_ctc_margin, median(ctc_margin)::DOUBLE AS median_ctc_margin, round(min(resized_width / greatest(target_length, 1)), 6) AS min_pixels_per_char, round(median(resized_width / greatest(target_length, 1)), 6) AS median_pixels_per_char FROM {ALIGNED}",
    "t06_round_trip": "SELECT p_partkey, CASE WHEN b = '' THEN length(p_name) ELSE 0 END AS encoded_length, CASE WHEN b = '' THEN p_name ELSE '' END AS decoded, b = '' AS roundtrip_ok, CASE WHEN b = '' THEN '' ELSE 'unknown characters: ' || b END AS error FROM (SELECT *, coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(p_name, ''), lambda c: instr(' abcdefghiklmnoprstu', c) = 0))), 'string_agg', ' '), '') AS b FROM part)",
    "t13_ctc_alignment": f"SELECT * FROM {ALIGNED}",
    "t14_target_audit": f"SELECT * FROM {AUDIT}",
    "a19_target_summary": f"SELECT count(*) AS n, max(token_count) AS max_token_count, quantile_cont(token_count, 0.95)::DOUBLE AS p95_token_count, count(*) FILTER (exceeds_max_label_length) AS over_label_rows, count(*) FILTER (exceeds_max_generation_length) AS over_generation_rows, count(*) FILTER (would_clip_aspect_canvas) AS clipped_rows, round(min(aspect_resized_width / greatest(char_len, 1)), 6) AS min_pixels_per_char, round(median(aspect_resized_width / greatest(char_len, 1)), 6) AS median_pixels_per_char FROM {AUDIT}",
    "t21_image_quality": f"SELECT q.ID, ahash, " + ", ".join(f"round({m}, {1 if m == 'sharpness_grad_var' else 4}) AS {m}" for m in images.METRICS if m != "dynamic_range_1_99") + f", round(p99 - p01, 4) AS dynamic_range_1_99 FROM {QUALITY} q JOIN {AHASH} h ON h.ID = q.ID",
    "s18_line_rows": "SELECT cast(vec_id AS varchar) AS ID, '/im/' || vec_id || '.jpg' AS image_path, 8 AS width, 64 AS n_pixels, coalesce(list_aggregate(list_transform(string_split(cast(label AS varchar), ''), lambda c: instr('0123456789', c)), 'string_agg', ' '), '') AS target_ids FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    "p03_only_fold": "SELECT p_partkey, p_partkey % 5 AS fold FROM part WHERE p_partkey % 5 = 3",
    "a20_readability": "SELECT CASE WHEN label % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(vec_id) AS n, count(*) FILTER (label <> 3) AS n_exists, count(*) FILTER (label % 5 <> 0) AS n_readable, count(*) FILTER (label % 5 = 0) AS bad_images FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1",
    "t22_resized_images": "SELECT cast(vec_id AS varchar) AS ID, 6 AS width, 4 AS height, 3 AS channels, 72 AS n_bytes FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    "a21_duplicate_images": f"SELECT substr(ahash, 1, 2) AS half, count(*) AS n, count(DISTINCT p.g) AS unique_files, count(DISTINCT p.label) AS unique_labels, list_aggregate(list_sort(list(p.ID))[1:20], 'string_agg', ',') AS ids, least(20, count(DISTINCT p.label)) AS n_labels FROM {AHASH} h JOIN {PICTURES} p ON p.ID = h.ID GROUP BY 1 HAVING count(*) > 1",
    "w02_duplicate_members": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "w03_once": "SELECT DISTINCT l_suppkey AS ID, l_linenumber AS image_path FROM lineitem",
    "w09_batch_width": f"SELECT ID, floor(doc_id / 16)::BIGINT AS batch, (ceil(max(width) OVER (PARTITION BY floor(doc_id / 16)) / 32) * 32)::INT AS padded_width FROM {MANIFEST_SQL}",
    "w10_batches": "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS batch FROM part",
    "s03_image_path": "SELECT p_partkey, '/data/images/' || p_partkey || '.jpg' AS image_path FROM part",
    "s17_window": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 10",
    "p10_holds_any": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[qzx]')",
    "p13_quality_flags": f"WITH f AS (SELECT ID, contrast_std < 4 AND foreground_ratio < 0.01 AS flag_almost_blank, brightness_mean < 80 AS flag_too_dark, brightness_mean > 245 AND foreground_ratio < 0.01 AS flag_too_bright_low_foreground, p99 - p01 < 20 AS flag_low_dynamic_range, sharpness_grad_var < 5 AS flag_low_sharpness, greatest(top_foreground_ratio, bottom_foreground_ratio) > 0.2 AS flag_top_or_bottom_crop, greatest(left_foreground_ratio, right_foreground_ratio) > 0.2 AS flag_left_or_right_crop FROM {QUALITY}) SELECT *, flag_almost_blank::INT + flag_too_dark::INT + flag_too_bright_low_foreground::INT + flag_low_dynamic_range::INT + flag_low_sharpness::INT + flag_top_or_bottom_crop::INT + flag_left_or_right_crop::INT AS quality_flag_count FROM f",
    "p14_consistency_flags": f"WITH {consistency_sql('SELECT p_partkey AS ID, p_size::DOUBLE AS width, p_retailprice::DOUBLE AS height, p_size / p_retailprice AS aspect_ratio, length(p_name) AS char_len FROM part')} SELECT ID, round(pixels_per_char, 6) AS pixels_per_char, round(rz_pixels_per_char, 6) AS rz_pixels_per_char, round(residual, 4) AS residual, {', '.join(CONSISTENCY)}, consistency_flag_count FROM c",
    "p12_label_flags": f"WITH {label_flags_sql(MANIFEST_SQL)} SELECT ID, max_run, n_flags, max_run >= 4 AS flag_repeated_chars, repeated_marks AS flag_repeated_marks FROM l",
    "j10_manual_review": f"WITH {label_flags_sql(MANIFEST_SQL)}, {consistency_sql(f'SELECT ID, width, height, width / height AS aspect_ratio, length(Target) AS char_len FROM {MANIFEST_SQL} WHERE doc_id % 3 <> 0')} SELECT l.ID, n_flags AS label_flag_count, coalesce(consistency_flag_count, 0) AS consistency_flag_count, n_flags + coalesce(consistency_flag_count, 0) AS total_flag_count FROM l LEFT JOIN c ON c.ID = l.ID",
    "u05_alphabets": "SELECT p_partkey, list_aggregate(list_sort(list_distinct(string_split(p_name, '') || string_split(p_brand, ''))), 'string_agg', '') AS both, coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(p_name, ''), lambda c: c IN ('a', 'z', '~')))), 'string_agg', ''), '') AS shared FROM part",
    "d06_output_steps": "SELECT p_partkey, greatest(1, p_size // 4)::BIGINT AS steps FROM part",
    "o05_rare_sample": "SELECT p_partkey, p_name FROM part ORDER BY regexp_matches(p_name, '[qz]') DESC, md5('42:' || p_partkey), p_partkey LIMIT 40",
    "o04_overfit_sample": "SELECT s.*, fold, CASE fold WHEN 0 THEN 'valid' ELSE 'train' END AS split FROM (SELECT p_partkey, p_name FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 32) s, (SELECT unnest([0, 1])::INT AS fold)",
    "t07_tokenize": "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ''), lambda c: CASE c WHEN ' ' THEN '<space>' ELSE c END), 'string_agg', ' ') AS tokens, p_name AS text FROM part",
    "t12_export_width": f"SELECT ID, greatest(1, round_even(width * 64 / height, 0))::BIGINT AS export_width, 'im/' || ID || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS shown FROM {MANIFEST_SQL}",
    "w06_fold_sizes": "WITH p AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, md5('42:' || c_custkey), c_custkey) - 1 AS k FROM customer) SELECT c_mktsegment, (k % 5)::INT AS fold, count(*) AS n FROM p GROUP BY ALL",
    "d01_greedy_decode": "SELECT vec_id, {T} AS text FROM (SELECT vec_id, list_transform(range(0, 8), lambda k: list_position(embedding[k * 8 + 1 : k * 8 + 8], list_max(embedding[k * 8 + 1 : k * 8 + 8])) - 1) AS i FROM embeddings)".replace("{T}", "coalesce(list_aggregate(list_transform(list_filter(list_zip(i, [NULL]::INT[] || i), lambda z: z[1] IS NOT NULL AND z[1] <> 0 AND z[1] IS DISTINCT FROM z[2]), lambda z: substr('ABCDEFG', z[1], 1)), 'string_agg', ''), '')"),
    "d01_greedy_lengths": "SELECT vec_id, {T} AS text FROM (SELECT vec_id, list_transform(range(0, vec_id % 8 + 1), lambda k: list_position(embedding[k * 8 + 1 : k * 8 + 8], list_max(embedding[k * 8 + 1 : k * 8 + 8])) - 1) AS i FROM embeddings)".replace("{T}", "coalesce(list_aggregate(list_transform(list_filter(list_zip(i, [NULL]::INT[] || i), lambda z: z[1] IS NOT NULL AND z[1] <> 0 AND z[1] IS DISTINCT FROM z[2]), lambda z: substr('ABCDEFG', z[1], 1)), 'string_agg', ''), '')"),
    "a08_majority_vote": f"""WITH s AS ({SOURCES_SQL}), v AS (SELECT ID, text, count(*) AS votes, min(source_idx) AS i FROM s WHERE trim(text) <> '' GROUP BY ALL),
 b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ID ORDER BY votes DESC, i) = 1)
 SELECT k.ID, coalesce(b.text, '') AS text, coalesce(b.votes, 0)::BIGINT AS votes FROM (SELECT DISTINCT ID FROM s) k LEFT JOIN b ON b.ID = k.ID""",
    "a14_char_frequency": "SELECT ch, count(*)::BIGINT AS n, count(DISTINCT p_partkey)::BIGINT AS n_rows FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY ch",
    "a21_duplicate_groups": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "a22_robust_z": "WITH m AS (SELECT median(p_retailprice) AS med FROM part), d AS (SELECT median(abs(p_retailprice - med)) AS mad FROM part, m) SELECT p_partkey, round(CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (p_retailprice - med) / mad END, 6) AS z FROM part, m, d",
    "t01_normalize": "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace('  ' || p_name || ' ' || chr(9) || ' ' || p_type, '\\s+', ' ', 'g'))), '[^A-Za-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM part",
    "w04_quantile_bins": "WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM customer) SELECT c_custkey, 'c' || greatest(0, len(list_filter(edges, lambda x: x < c_acctbal)) - 1) AS c_acctbal_bin FROM customer, e",
    "a13_source_scores": f"WITH s AS ({SOURCES_SQL}) SELECT source_idx, count(*) AS n, sum(levenshtein(p_name, text))::BIGINT AS char_edits, sum(length(p_name))::BIGINT AS ref_chars, round(sum(levenshtein(p_name, text)) / sum(length(p_name)), 6) AS cer FROM s JOIN part ON cast(p_partkey AS varchar) = ID GROUP BY source_idx",
    "a19_token_summary": "SELECT count(*) AS n, min(t) AS least, median(t)::DOUBLE AS middle, quantile_cont(t, 0.95)::DOUBLE AS p95, max(t) AS most, count(*) FILTER (t > 16) AS n_over FROM (SELECT length(p_name) + 2 AS t FROM part)",
    "a23_residuals": "WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part) SELECT p_partkey, round(p_retailprice - a - b * p_size, 4) AS residual FROM part, m",
    "a24_overview": " UNION ALL ".join(f"SELECT '{c}' AS name, '{t}' AS kind, count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) / count(*), 9) AS missing_pct, count(DISTINCT {c}) AS distinct FROM documents" for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"))),
    "a25_describe": "SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS deviation, min(c_acctbal) AS least, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.75) AS p75, max(c_acctbal) AS most FROM customer",
    "a25_correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")),
    "a26_top_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(label), '\\b\\S+\\b')) AS word FROM {LABELS_SQL}) GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "a26_all_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(label), '\\b\\S+\\b')) AS word FROM {LABELS_SQL}) GROUP BY word",
    "a26_top_chars": f"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(label, '')) AS ch FROM {LABELS_SQL}) GROUP BY ch ORDER BY n DESC, ch LIMIT 50",
    "a26_top_targets": f"SELECT label, count(*) AS n FROM {LABELS_SQL} GROUP BY label ORDER BY n DESC, label NULLS FIRST LIMIT 30",
    "a27_label_integrity": f"SELECT count(*) AS rows, count(*) FILTER (label IS NULL) AS missing_labels, count(*) FILTER (trim(coalesce(label, '')) = '') AS empty_after_normalize, count(DISTINCT coalesce(label, 'nan')) AS unique_exact_labels, count(*) FILTER (copies > 1) AS duplicated_exact_label_rows FROM (SELECT *, count(*) OVER (PARTITION BY label) AS copies FROM {LABELS_SQL})",
    "a27_id_integrity": "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS unique_ids, count(*) FILTER (copies > 1) AS duplicate_id_rows, count(*) FILTER (o_custkey IS NULL) AS missing_id_rows, count(*) - count(DISTINCT o_custkey) AS duplicate_ids FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS copies FROM orders)",
    "t19_categories": f"SELECT category, count(*) AS n, count(DISTINCT p_partkey) AS n_rows FROM (SELECT p_partkey, CASE WHEN ch BETWEEN 'A' AND 'Z' THEN 'Lu' WHEN ch BETWEEN 'a' AND 'z' THEN 'Ll' WHEN ch BETWEEN '0' AND '9' THEN 'Nd' WHEN ch = ' ' THEN 'Zs' WHEN ch = '(' THEN 'Ps' WHEN ch = ')' THEN 'Pe' WHEN ch = '-' THEN 'Pd' WHEN ch IN ('!', '\"', '#', ',', ';') THEN 'Po' ELSE '?' END AS category FROM (SELECT p_partkey, unnest(string_split(label, '')) AS ch FROM {LABELS_SQL}) WHERE ch <> '') GROUP BY category",
    "p12_repeats": f"""WITH x AS (SELECT p_partkey, coalesce(label, '') AS raw, trim(regexp_replace(coalesce(label, ''), '\\s+', ' ', 'g')) AS t FROM {LABELS_SQL}), q AS (SELECT quantile_cont(length(t), 0.01) AS lo, quantile_cont(length(t), 0.99) AS hi FROM x),
 r AS (SELECT p_partkey, max(n) AS max_run, bool_or(n > 1 AND regexp_matches(ch, '[[:punct:]]')) AS repeated_marks FROM (SELECT p_partkey, ch, spot - k AS island, count(*) AS n FROM (SELECT p_partkey, ch, spot, row_number() OVER (PARTITION BY p_partkey, ch ORDER BY spot) AS k FROM (SELECT p_partkey, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS spot FROM x)) GROUP BY ALL) GROUP BY p_partkey),
 f AS (SELECT x.p_partkey, CASE WHEN t = '' THEN 1 ELSE max_run END AS max_run, t <> '' AND repeated_marks AS repeated_marks, round(length(regexp_replace(t, '[^[:punct:]]', '', 'g')) / greatest(length(t), 1), 6) AS punct_ratio, t = '' AS flag_empty, raw <> '' AND (left(raw, 1) = ' ' OR right(raw, 1) = ' ' OR contains(raw, '  ')) AS flag_whitespace, false AS flag_control, false AS flag_non_ascii, length(t) <= lo AS flag_very_short, length(t) >= hi AS flag_very_long, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / greatest(length(t), 1) < 0.55 AS flag_low_alpha FROM x JOIN r ON r.p_partkey = x.p_partkey, q)
 SELECT *, max_run >= 4 AS flag_repeated_chars, repeated_marks AS flag_repeated_marks, (flag_empty::INT + flag_whitespace::INT + flag_very_short::INT + flag_very_long::INT + flag_low_alpha::INT + (max_run >= 4)::INT + repeated_marks::INT)::INT AS n_flags FROM f""",
    "u03_overlap": "WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey + 10 AS k FROM orders) SELECT CASE WHEN c.k IS NULL THEN 'extra' WHEN o.k IS NULL THEN 'missing' ELSE 'shared' END AS side, count(*) AS n FROM c FULL JOIN o ON c.k = o.k GROUP BY 1",
    "w10_line_batches": "SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000 AS batch FROM lineitem",
    "o03_late_window": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3000 OFFSET 5000",
    "w04_exact_quantiles": " UNION ALL ".join(f"SELECT '{c}' AS name, {q}::DOUBLE AS share, round(quantile_cont({c}::DOUBLE, {q}), 6) AS value FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_discount") for q in (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)),
    "w11_resumed_work": "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)",
    "a29_best_epoch": "SELECT l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY 1 ORDER BY sum(l_discount * l_quantity) / sum(l_quantity), 1 LIMIT 1",
    "j09_submission": "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
    "p02_fold_split": "SELECT CASE WHEN p_partkey % 5 = 2 THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM part GROUP BY 1",
    "p11_label_features": "SELECT p_partkey, length(t) AS char_len, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS word_len, raw <> '' AND (left(raw, 1) = ' ' OR right(raw, 1) = ' ') AS edge_space, contains(raw, '  ') AS repeated_space, t = '' AS empty, round(length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1), 6) AS digit_ratio, round(length(regexp_replace(t, '[^A-Za-zé]', '', 'g')) / greatest(length(t), 1), 6) AS alpha_ratio, contains(t, 'é') AS non_ascii FROM (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || 'é' WHEN 2 THEN ' ' || p_name ELSE p_name || '  ' || p_brand || '!!' END AS raw FROM part))",
    "s10_decoder_lines": "SELECT p_partkey || '.v1' AS ID, p_name AS Target FROM part",
    "s12_path_lines": "SELECT cast(p_partkey AS varchar) AS ID, p_name AS Target FROM part",
    "t03_unicode_form": "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents",
    "t04_encode": "SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split(lower(p_name), ''), lambda c: instr('abcdefghijklm ', c) > 0), lambda c: instr('abcdefghijklm ', c)), 'string_agg', ' ') AS ids, coalesce(list_aggregate(list_sort(list_distinct(list_filter(string_split(lower(p_name), ''), lambda c: instr('abcdefghijklm ', c) = 0))), 'string_agg', ''), '') AS unknown FROM part",
    "t16_rerank_score": "SELECT p_partkey, round(p_retailprice - 0.5 * greatest(0, 20 - length(t)) - CASE p_partkey % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 5.0 ELSE 0 END, 6) AS score FROM (SELECT *, p_name || CASE p_partkey % 3 WHEN 0 THEN '!!' WHEN 1 THEN '  x ' ELSE '' END AS t FROM part)",
    "u02_id_difference": "SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 10 FROM orders) UNION ALL SELECT DISTINCT o_custkey + 10, 'extra' FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)",
    "w05_coarsen": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) < 3 THEN p_brand ELSE p_brand || '-' || p_size END AS label FROM part",
}
