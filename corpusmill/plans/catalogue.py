"""The named queries over the Parquet tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import longest_match
from corpusmill.operators import classify, ovr, sampling, text, weighting
from corpusmill.session import materialise
from corpusmill.sources import corpus, count_documents, index_lines, parquet, parse_score_lines, score_lines

#: Classes of the driver's corpus.
LANGS = ["de", "en", "es", "fr"]
#: Stopwords for the driver's four languages.
STOP = ["a", "and", "as", "by", "de", "der", "des", "die", "el", "en", "for", "in", "is", "la", "le", "les", "of", "on", "que", "the", "to", "und", "was", "with"]
N_CLASSES = 14


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus(parquet(spark, f"{d}/documents.parquet"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("doc_id % 5 <> 0")


def _test(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("doc_id % 5 = 0")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """term_lists() as a table: a query that needs terms more than once splits every text once."""
    return materialise(text.term_lists(_docs(spark, d)), "terms")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return text.listed(_lists(spark, d))


def _known(tf: DataFrame) -> DataFrame:
    """The vocabulary as a table: its rows are counted before it is joined."""
    return materialise(text.vocabulary(tf), "vocabulary")


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return text.vocabulary(text.terms(_docs(spark, d)))


def _idf(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = weighting.idf(_vocab(spark, d), count_documents(_docs(spark, d)), kind)
        return out.select("term", F.round(F.col("idf").cast("double"), 6).alias("idf"))

    return query


def _weights(spark: SparkSession, d: str, vocab: DataFrame) -> DataFrame:
    return weighting.idf(vocab, count_documents(_docs(spark, d)))


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Terms outside the vocabulary have no weight, so the join with the weights is the filter too."""
    tf = _terms(spark, d)
    return weighting.weigh(tf, _weights(spark, d, _known(tf)), "n")


def _l1(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, term, ntf, idf."""
    lists = _lists(spark, d)
    return weighting.l1_in_rows(lists, _weights(spark, d, _known(text.listed(lists))))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """term_lists() and a table (term, idx, idf) of the vocabulary, from one split of the texts."""
    lists = _lists(spark, d)
    vocab = _known(text.listed(lists))
    return lists, materialise(_weights(spark, d, vocab).join(text.vocab_index(vocab), "term"), "places")


def _bow(spark: SparkSession, d: str) -> DataFrame:
    return weighting.bow_string_in_rows(*_indexed(spark, d))


def _vocab_index(spark: SparkSession, d: str) -> DataFrame:
    return text.vocab_index(materialise(_vocab(spark, d), "vocabulary"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    tf = _terms(spark, d)
    return text.kept_counts(_docs(spark, d), tf, _known(tf))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    tf = _terms(spark, d)
    return weighting.tf_counts(tf, _known(tf))


def _slot_sums(spark: SparkSession, d: str) -> DataFrame:
    return weighting.hash_slots_in_rows(*_indexed(spark, d)).withColumn("val", F.round("val", 6))


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, term, n by a segmenter with a word list."""
    return text.terms(text.token_arrays(_docs(spark, d), longest_match(["体育", "新闻"])), words=F.col("tokens"))


def _score_lines(spark: SparkSession, d: str) -> DataFrame:
    """Scores as lines, parsed again, least score first."""
    back = parse_score_lines(score_lines(_scores(spark, d)))
    return ovr.argmin_class(_docs(spark, d), back.select(F.col("doc").cast("long").alias("doc_id"), "cls", "score"), N_CLASSES)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    cls = spark.range(N_CLASSES).select(F.col("id").alias("cls"))
    grid = _docs(spark, d).select("doc_id").crossJoin(F.broadcast(cls)).where((F.col("doc_id") + F.col("cls")) % 3 != 0)
    return grid.select("doc_id", "cls", ((F.col("doc_id") * 7 + F.col("cls") * 5) % 11 - 5).cast("double").alias("score"))


def _model(name: str, **options):
    def query(spark: SparkSession, d: str) -> DataFrame:
        label = F.expr("cast(array_position(array('de','en','es','fr'), label_name) - 1 as double)")
        own = ["text", "label_name"] if name == "NB" else []  # what its SQL works on: other terms than the features'
        tr, te = (text.token_arrays(x).withColumn("label", label).select("doc_id", "tokens", "label", *own) for x in (_train(spark, d), _test(spark, d)))
        a, b = classify.counted_features(tr, te, weight=name != "NB")
        more = dict(options)
        if name == "MLP":
            more["layers"] = [a.select("features").head()[0].size, 16, len(LANGS)]
        out = classify.fit_predict(name, a if own else materialise(a, "features"), b, **more)
        return out.select("doc_id", F.col("prediction").cast("int").alias("prediction"))

    return query


def _hashing(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, nnz, slots, weights of every document; frequencies come from the training rows."""
    tr, every = (text.token_arrays(x) for x in (_train(spark, d), _docs(spark, d)))
    _, out = classify.hashed_features(tr, every, l1=True)

    def entries(v):
        some = [(int(i), float(x)) for i, x in zip(v.indices, v.values, strict=True) if x]
        return len(some), [i for i, _ in some], [x for _, x in some]

    cells = F.udf(entries, "nnz int, slots array<int>, weights array<double>")
    return out.select("doc_id", cells("features").alias("f")).select("doc_id", "f.*")


def _index_lines(spark: SparkSession, d: str) -> DataFrame:
    idx = text.inverted_index(text.terms(_docs(spark, d)))
    line = F.concat(F.lit("<"), "term", F.lit("> "), F.col("total").cast("string"), F.lit(",0\t"), "postings")
    return text.postings_to_terms(index_lines(materialise(idx.select(line.alias("value")), "lines"))).select(F.col("doc_id").cast("long").alias("doc_id"), "term", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tf = lambda s, d: text.terms(_docs(s, d))
    r6 = lambda df, c: df.withColumn(c, F.round(c, 6))
    return {
        "corpus_scan": _docs,
        "corpus_stats": lambda s, d: text.corpus_stats(_docs(s, d)),
        "class_union": lambda s, d: text.class_union(_docs(s, d), LANGS),
        "label_index": lambda s, d: text.label_index(_docs(s, d)),
        "tokenize": tf,
        "stopword_removal": lambda s, d: text.without_stopwords(text.token_arrays(_docs(s, d)), STOP).select("doc_id", F.size("tokens").cast("long").alias("n_kept")),
        "word_count": lambda s, d: text.word_count(_docs(s, d)),
        "top_terms": lambda s, d: text.top_terms(_docs(s, d), 100),
        "script_filter": lambda s, d: text.script_terms(_docs(s, d), "latin"),
        "vocabulary": _vocab,
        "vocab_index": _vocab_index,
        "segmented_tokens": _segmented,
        "prefix_label": lambda s, d: _docs(s, d).select("doc_id", text.prefix_label(F.concat("label_name", F.lit("-"), "doc_id")).alias("label_name")),
        "score_lines": _score_lines,
        "idf_single": _idf("single"),
        "inverted_index": lambda s, d: text.inverted_index(tf(s, d)),
        "index_lines": _index_lines,
        "vocab_filter_docs": _kept,
        "doc_freq": lambda s, d: text.doc_freq(tf(s, d)),
        "idf_mr": _idf("plain"),
        "idf_ml": _idf("smooth"),
        "tf_counts": _counts,
        "tf_l1": lambda s, d: r6(_l1(s, d).select("doc_id", "term", "ntf"), "ntf"),
        "tfidf": lambda s, d: r6(_tfidf(s, d), "val"),
        "tfidf_l1": lambda s, d: r6(_l1(s, d).select("doc_id", "term", (F.col("ntf") * F.col("idf")).alias("val")), "val"),
        "bow_string": _bow,
        "bow_parse": lambda s, d: weighting.bow_parse(_bow(s, d)),
        "hash_slots": lambda s, d: weighting.slot_load(_vocab_index(s, d)),
        "hash_slot_sums": _slot_sums,
        "ovr_fanout": lambda s, d: ovr.fan_out(_docs(s, d), text.label_index(_docs(s, d))).groupBy("cls", "y").agg(F.count(F.lit(1)).alias("cnt")),
        "systematic_sample": lambda s, d: sampling.systematic(_docs(s, d).select("doc_id"), 48),
        "systematic_by_class": lambda s, d: sampling.systematic_by_class(_docs(s, d).select("doc_id", "label_name"), 20, "label_name"),
        "random_sample": lambda s, d: sampling.random_rows(_docs(s, d).select("doc_id"), 100),
        "ovr_predict": lambda s, d: ovr.argmin_class(_docs(s, d), _scores(s, d), N_CLASSES),
        "nb_sql": lambda s, d: classify.naive_bayes(_train(s, d), _test(s, d)).select("doc_id", "prediction"),
        "accuracy": lambda s, d: ovr.accuracy(classify.naive_bayes(_train(s, d), _test(s, d)), "label_name"),
        "nb_predict": _model("NB"),
        "lr_predict": _model("LR"),
        "svm_predict": _model("SVM"),
        "bilr_predict": _model("BILR"),
        "mlp_predict": _model("MLP"),
        "tree_predict": _model("DT"),
        "forest_predict": _model("RF"),
        "hashing_tf": _hashing,
    }


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


_ROWS = "SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text,'')), '[^\\p{L}]+')) AS term FROM documents"
_TOK = f"tok AS (SELECT doc_id, term FROM ({_ROWS}) WHERE term <> '')"
_TF = "tf AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL)"
_VOC = "vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS c, count(*) AS df FROM tf WHERE length(term) > 1 AND regexp_full_match(term, '\\p{L}+') GROUP BY term HAVING sum(n) > 10)"
_N = "nd AS (SELECT count(*) AS n_docs FROM documents)"
_IDF = "idf AS (SELECT term, ln(CAST(n_docs + 1 AS DOUBLE) / (df + 1)) AS idf FROM vocab, nd)"
_IDX = "idx AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS idx FROM vocab)"
_W = "w AS (SELECT doc_id, term, n * idf AS val FROM tf JOIN idf USING (term))"
_BOW = "bow AS (SELECT d.doc_id, coalesce(v, '') AS vec FROM documents d LEFT JOIN (SELECT doc_id, string_agg(printf('%d:%.4f', idx, val), ' ' ORDER BY idx) AS v FROM w JOIN idx USING (term) GROUP BY doc_id) b USING (doc_id))"
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(idx AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"
_SLOT = f"CAST((CASE WHEN {_HASH} >= 2147483648 THEN {_HASH} - 4294967296 ELSE {_HASH} END) % 87423 AS BIGINT)"
_NB = (
    _TOK, _TF,
    "train AS (SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0)",
    "tv AS (SELECT term FROM tf JOIN train USING (doc_id) WHERE length(term) > 1 GROUP BY term HAVING sum(n) > 10)",
    "cls AS (SELECT lang, count(*) AS docs FROM train GROUP BY lang)",
    "u AS (SELECT term, lang, sum(n) AS tc FROM tf JOIN train USING (doc_id) JOIN tv USING (term) GROUP BY ALL)",
    "m AS (SELECT lang, sum(tc) AS mass FROM u GROUP BY lang)",
    "pri AS (SELECT lang, ln(docs + 1.0) - ln((SELECT sum(docs) FROM cls) + (SELECT count(*) FROM cls) * 1.0) AS prior, ln(coalesce(mass, 0) + (SELECT count(*) FROM tv) * 1.0) AS lm FROM cls LEFT JOIN m USING (lang))",
    "th AS (SELECT tv.term, pri.lang, ln(coalesce(tc, 0) + 1.0) - lm AS theta FROM tv CROSS JOIN pri LEFT JOIN u ON u.term = tv.term AND u.lang = pri.lang)",
    "sc AS (SELECT d.doc_id, d.lang AS own, pri.lang, round(prior + coalesce(s, 0), 6) AS score FROM documents d CROSS JOIN pri LEFT JOIN (SELECT doc_id, lang, sum(n * theta) AS s FROM tf JOIN th USING (term) GROUP BY ALL) x ON x.doc_id = d.doc_id AND x.lang = pri.lang WHERE d.doc_id % 5 = 0)",
    "nb AS (SELECT doc_id, own, lang AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM sc) WHERE r = 1)",
)


def oracle_sql() -> dict[str, str]:
    base, lex = (_TOK, _TF), (_TOK, _TF, _VOC)
    weights = (*lex, _N, _IDF, _W)
    stop = ", ".join(f"'{w}'" for w in STOP)
    return {
        "corpus_scan": "SELECT doc_id, text, lang AS label_name FROM documents",
        "corpus_stats": "SELECT lang AS label_name, count(*) AS docs FROM documents GROUP BY lang",
        "class_union": " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS INTEGER) AS label FROM documents WHERE lang = '{n}'" for i, n in enumerate(LANGS)),
        "label_index": "SELECT lang AS label_name, dense_rank() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents)",
        "tokenize": _with(*base) + "SELECT doc_id, term, n FROM tf",
        "stopword_removal": _with(_TOK) + f"SELECT d.doc_id, count(term) AS n_kept FROM documents d LEFT JOIN (SELECT * FROM tok WHERE term NOT IN ({stop})) USING (doc_id) GROUP BY d.doc_id",
        "word_count": _with(_TOK) + "SELECT term, count(*) AS c FROM tok GROUP BY term",
        "top_terms": _with(_TOK) + "SELECT term, count(*) AS c FROM tok GROUP BY term ORDER BY c DESC, encode(term) LIMIT 100",
        "script_filter": _with(_TOK) + "SELECT DISTINCT term FROM tok WHERE regexp_full_match(term, '[a-z]+')",
        "vocabulary": _with(*lex) + "SELECT term, c, df FROM vocab",
        "vocab_index": _with(*lex, _IDX) + "SELECT term, idx FROM idx",
        "inverted_index": _with(*base) + "SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS df, string_agg(doc_id || ': ' || n, ';' ORDER BY doc_id) AS postings FROM tf GROUP BY term",
        "index_lines": _with(*base) + "SELECT doc_id, term, n FROM tf",
        "vocab_filter_docs": _with(*lex) + "SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_kept FROM documents d LEFT JOIN (SELECT doc_id, n FROM tf SEMI JOIN vocab USING (term)) USING (doc_id) GROUP BY d.doc_id",
        "doc_freq": _with(*base) + "SELECT term, count(*) AS df FROM tf GROUP BY term",
        "idf_mr": _with(*lex, _N) + "SELECT term, round(ln(CAST(n_docs AS DOUBLE) / (df + 1)), 6) AS idf FROM vocab, nd",
        "idf_ml": _with(*lex, _N, _IDF) + "SELECT term, round(idf, 6) AS idf FROM idf",
        "tf_counts": _with(*lex) + "SELECT doc_id, term, n FROM tf SEMI JOIN vocab USING (term)",
        "tf_l1": _with(*lex) + "SELECT doc_id, term, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id), 6) AS ntf FROM tf SEMI JOIN vocab USING (term)",
        "tfidf": _with(*weights) + "SELECT doc_id, term, round(val, 6) AS val FROM w",
        "tfidf_l1": _with(*lex, _N, _IDF) + "SELECT doc_id, term, round(ntf * idf, 6) AS val FROM (SELECT doc_id, term, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) AS ntf FROM tf SEMI JOIN vocab USING (term)) JOIN idf USING (term)",
        "bow_string": _with(*weights, _IDX, _BOW) + "SELECT doc_id, vec FROM bow",
        "bow_parse": _with(*weights, _IDX, _BOW) + "SELECT doc_id, CAST(split_part(x, ':', 1) AS BIGINT) AS idx, CAST(split_part(x, ':', 2) AS DOUBLE) AS val FROM (SELECT doc_id, unnest(string_split(vec, ' ')) AS x FROM bow WHERE vec <> '')",
        "hash_slots": _with(*lex, _IDX) + f"SELECT slot, count(*) AS n FROM (SELECT {_SLOT} AS slot FROM idx) GROUP BY slot",
        "hash_slot_sums": _with(*weights, _IDX) + f"SELECT doc_id, slot, round(sum(val), 6) AS val FROM (SELECT doc_id, {_SLOT} AS slot, val FROM w JOIN idx USING (term)) GROUP BY ALL",
        "ovr_fanout": "WITH c AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS cls FROM (SELECT DISTINCT lang FROM documents)) SELECT cls, CAST(d.lang = c.lang AS INTEGER) AS y, count(*) AS cnt FROM documents d, c GROUP BY ALL",
        "systematic_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 48 = 0",
        "systematic_by_class": "SELECT doc_id, label_name FROM (SELECT doc_id, lang AS label_name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 20 = 0",
        "ovr_predict": f"SELECT doc_id, prediction FROM (SELECT doc_id, CAST(cls AS INTEGER) AS prediction, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN (doc_id + cls) % 3 <> 0 THEN (doc_id * 7 + cls * 5) % 11 - 5 ELSE 0 END, cls) AS r FROM documents, range({N_CLASSES}) t(cls)) WHERE r = 1",
        "segmented_tokens": _with(*base) + "SELECT doc_id, term, n FROM tf",
        "prefix_label": "SELECT doc_id, lang AS label_name FROM documents",
        "score_lines": f"SELECT doc_id, prediction FROM (SELECT doc_id, CAST(cls AS INTEGER) AS prediction, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN (doc_id + cls) % 3 <> 0 THEN (doc_id * 7 + cls * 5) % 11 - 5 ELSE 0 END, cls) AS r FROM documents, range({N_CLASSES}) t(cls)) WHERE r = 1",
        "idf_single": _with(*lex, _N) + "SELECT term, round(CAST(CAST(ln(CAST(CAST(n_docs AS FLOAT) / CAST(df + 1 AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS idf FROM vocab, nd",
        "random_sample": "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
        "nb_predict": _with(*_NB) + "SELECT doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], prediction) - 1 AS INTEGER) AS prediction FROM nb",
        "nb_sql": _with(*_NB) + "SELECT doc_id, prediction FROM nb",
        "accuracy": _with(*_NB) + "SELECT avg(CAST(own = prediction AS DOUBLE)) AS accuracy, avg(CAST(own = prediction AS DOUBLE)) * 100 AS accuracy_pct FROM nb",
    }


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """TF-IDF weights of the corpus."""
    return queries()["tfidf"](spark, d)



