
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import in_script, java_hash
from corpusmill.operators import classify, ovr, sampling, text, weighting
from corpusmill.operators.ranking import with_position
from corpusmill.plans import catalogue
from corpusmill.sources import index_lines, raw_corpus, write_delimited
from tests.oracle import connect, same


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, label_name string")


def test_stopwords_ignore_case(spark):
    df = spark.createDataFrame([(["a", "A", "b"],)], "tokens array<string>")
    assert text.without_stopwords(df, ["a "]).first().tokens == ["b"]
    assert classify.remove_stopwords(df, ["a "]).first().cleaned == ["b"]


def test_frequency_is_strict(spark):
    tf = spark.createDataFrame([(1, "xx", 10), (1, "yy", 11), (1, "z", 50)], "doc_id long, term string, n long")
    assert [r.term for r in text.vocabulary(tf).collect()] == ["yy"]


def test_script(spark):
    df = spark.createDataFrame([("体育",), ("体a",)], "t string")
    assert [r.t for r in df.where(in_script(F.col("t"), "cjk")).collect()] == ["体育"]


def test_vocabulary_filter_keeps_order_repeats_and_empty(spark):
    d = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y"]), (3, [])], "doc_id long, tokens array<string>")
    v = spark.createDataFrame([("x",)], "term string")
    assert {r.doc_id: r.tokens for r in text.keep_vocabulary(d, v).collect()} == {1: ["x", "x"], 2: [], 3: []}


def test_idf(spark):
    v = spark.createDataFrame([("p", 2), ("q", 1)], "term string, df long")
    n = spark.createDataFrame([(3,)], "n_docs long")
    smooth = {r.term: round(r.idf, 6) for r in weighting.idf(v, n).collect()}
    plain = {r.term: round(r.idf, 6) for r in weighting.idf(v, n, "plain").collect()}
    assert smooth == {"p": 0.287682, "q": 0.693147} and plain == {"p": 0.0, "q": 0.405465}


def test_l1(spark):
    tf = spark.createDataFrame([(1, t, n) for t, n in zip("abcde", (1, 1, 1, 1, 2), strict=True)], "doc_id long, term string, n long")
    assert sorted(round(r.ntf, 6) for r in weighting.tf_l1(tf).collect()) == [round(x, 6) for x in (1 / 6, 1 / 6, 1 / 6, 1 / 6, 1 / 3)]


def test_index_in_byte_order(spark):
    v = spark.createDataFrame([("é",), ("z",), ("abcdefgh",), ("abcdefg",)], "term string")
    assert {r.term: r.idx for r in text.vocab_index(v).collect()} == {"abcdefg": 0, "abcdefgh": 1, "z": 2, "é": 3}


def test_position_matches_a_plain_sort(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k == r.idx for r in with_position(df, [F.col("k")], F.col("k")).collect())


def test_argmin_tie_and_missing(spark):
    d = spark.createDataFrame([(1,), (2,)], "doc_id long")
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 3.0), (1, 3, 9.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)], "doc_id long, cls int, score double")
    assert {r.doc_id: r.prediction for r in ovr.argmin_class(d, s, 4).collect()} == {1: 0, 2: 3}


def test_fan_out(spark):
    c = spark.createDataFrame([(chr(97 + i), i) for i in range(14)], "label_name string, label long")
    out = ovr.fan_out(docs(spark, "x"), c).collect()
    assert len(out) == 14 and sum(r.y for r in out) == 1


def test_systematic(spark):
    assert sorted(r.id for r in sampling.systematic(spark.range(97), 48, "id").collect()) == [0, 48, 96]


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 0)], "label int, prediction int")
    assert tuple(ovr.accuracy(df).first()) == (0.75, 75.0)


def test_java_hash(spark):
    df = spark.createDataFrame([("12345",), ("87422",), ("",), ("polygenelubricants",)], "s string")
    assert [r[0] for r in df.select(java_hash(F.col("s"))).collect()] == [46792755, 53407253, 0, -2147483648]


def test_bow_round_trip(spark):
    d = docs(spark, "aa bb aa", "", None)
    tf = text.terms(d)
    w = weighting.weigh(tf, spark.createDataFrame([("aa", 0.5), ("bb", 2.0)], "term string, idf double"), "n")
    idx = spark.createDataFrame([("aa", 0), ("bb", 1)], "term string, idx long")
    bow = weighting.bow_string(d, w, idx)
    assert {r.doc_id: r.vec for r in bow.collect()} == {0: "0:1.0000 1:2.0000", 1: "", 2: ""}
    assert sorted(map(tuple, weighting.bow_parse(bow).collect())) == [(0, 0, 1.0), (0, 1, 2.0)]


def test_index_lines(spark):
    df = spark.createDataFrame([("<ab> 5,x\td1: 2;d2: 3",), ("<c> 1,x",)], "value string")
    out = index_lines(df).collect()
    assert [(r.term, r.total, [tuple(p) for p in r.postings]) for r in out] == [("ab", 5, [("d1", 2), ("d2", 3)]), ("c", 1, [])]


def test_raw_corpus_keeps_empty_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "1").write_text("")
    (tmp_path / "k" / "2").write_text("x\ny")
    got = {(r.label_name, r.text) for r in raw_corpus(spark, f"{tmp_path}/*/*").collect()}
    assert got == {("k", ""), ("k", "x\ny")}
    assert raw_corpus(spark, f"{tmp_path}/*/*", keep_empty=False).count() == 1


def test_delimited(spark, tmp_path):
    write_delimited(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/o")
    assert spark.read.text(f"{tmp_path}/o").first().value == "1\t"


def test_naive_bayes_matches_ml(spark):
    d = "/root/testdata/sf0.001"
    from corpusmill.plans.catalogue import LANGS, queries

    a = {r.doc_id: r.prediction for r in queries()["nb_sql"](spark, d).collect()}
    assert set(a.values()) <= set(LANGS) and len(a) == 40


def test_smoothing_by_hand(spark):
    train = spark.createDataFrame([(1, "aa aa", "x"), (2, "bb", "y")], "doc_id long, text string, label_name string")
    test = spark.createDataFrame([(3, "aa", "x"), (4, "", "y")], "doc_id long, text string, label_name string")
    got = {r.doc_id: r.prediction for r in classify.naive_bayes(train, test, min_count=0).collect()}
    assert got == {3: "x", 4: "x"}


def test_feature_job(spark, tmp_path):
    from corpusmill.plans.jobs import build_features, train_model

    for part in ("train", "test"):
        for c in ("u", "v"):
            (tmp_path / part / c).mkdir(parents=True)
            for i in range(4):
                (tmp_path / part / c / f"{i}").write_text(f"{'red apple' if c == 'u' else 'blue sky'} " * 5)
    build_features(spark, str(tmp_path), None, f"{tmp_path}/out", True, "latin")
    assert train_model(spark, "NB", f"{tmp_path}/out/train", f"{tmp_path}/out/test", f"{tmp_path}/r.txt") == 1.0
    assert (tmp_path / "r.txt").read_text().startswith("Accuracy: 1.0")


def test_models_see_the_whole_vocabulary(spark, monkeypatch):
    """Every term in 10 or more training rows is a feature; 2,972 at sf0.01."""
    from corpusmill.plans import catalogue

    d, seen = "/root/testdata/sf0.01", {}

    def note(name, train, test, **options):
        seen[name] = (train.head().features.size, options.get("layers"))
        return test.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(classify, "fit_predict", note)
    names = ("nb", "lr", "svm", "bilr", "mlp", "tree", "forest")
    for n in names:
        catalogue.queries()[f"{n}_predict"](spark, d)
    terms = text.terms(catalogue._train(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 10").count()
    assert len(seen) == len(names) and {size for size, _ in seen.values()} == {terms} and seen["MLP"][1][0] == terms


def test_hashing_covers_every_document(spark, tmp_path):
    """Train and test rows and a null id each have their slots and weights."""
    import math

    from pyspark.ml.feature import HashingTF

    from corpusmill.plans import catalogue

    rows = [(i, f"aa bb{' cc' * (i % 3)} d{'xyz'[i % 3]}", "en") for i in range(10)] + [(None, "aa cc", "en"), (11, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalogue.queries()["hashing_tf"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    slot, train = HashingTF(numFeatures=1 << 18).indexOf, [t.split() for i, t, _ in rows if i is not None and i % 5 and t] + [[]]
    for i, t, _ in rows:
        words, want = (t or "").split(), {}
        for w in set(words):
            x = words.count(w) / len(words) * math.log((len(train) + 1) / (sum(w in d for d in train) + 1))
            want |= {slot(w): x} if x else {}
        r = got[i]
        assert r.nnz == len(want) and r.slots == sorted(want)
        assert all(abs(x - want[s]) < 1e-12 for s, x in zip(r.slots, r.weights, strict=True))


def test_segmentation(spark):
    """Chinese words by the longest match in a list, other letters by runs."""
    from corpusmill.functions import longest_match

    d = docs(spark, "体育新闻，News 2024 新体育", None, "")
    got = text.token_arrays(d, longest_match(["体育", "新闻", "体育新"])).orderBy("doc_id").collect()
    assert [r.tokens for r in got] == [["体育新", "闻", "news", "新", "体育"], [], []]


def test_score_lines(spark):
    from corpusmill.sources import parse_score_lines

    df = spark.createDataFrame([("a.txt|3|positive|-0.5 ",), ("b|0|1.25 ",), ("c",)], "value string")
    assert [tuple(r) for r in parse_score_lines(df).collect()] == [("a.txt", 3, -0.5), ("b", 0, 1.25), ("c", None, None)]


def test_single_precision(spark):
    v = spark.createDataFrame([("p", 2), ("q", 1)], "term string, df long")
    n = spark.createDataFrame([(3,)], "n_docs long")
    assert {r.term: round(r.idf, 6) for r in weighting.idf(v, n, "single").collect()} == {"p": 0.0, "q": 0.405465}


def test_chain_from_files_to_accuracy(spark, tmp_path):
    from corpusmill.plans import chain

    at = lambda x: f"{tmp_path}/{x}"
    words = {"ball": "aa", "goal": "aa", "bank": "bb", "fund": "bb", "both": "aabb"}
    line = [f"<{w}> 9,0\t" + ";".join(f"{c}{i}: {2 + i % 3}" for i in range(8) for c in ("aa", "bb") if c in cs) for w, cs in words.items()]
    spark.createDataFrame([(x,) for x in line], "value string").write.text(at("index"))
    chain.idf_job(spark, at("index"), 16, at("idf"))
    chain.bow_job(spark, at("index"), at("idf"), at("bow"))
    vectors = {r.value.split("\t")[0]: r.value.split("\t")[1] for r in spark.read.text(at("bow")).collect()}
    # ln(16 / 9) = 0.5754 for the words of one class, ln(16 / 17) = -0.0606 for the common one, twice each in the first file
    assert len(vectors) == 16 and vectors["aa0"] == "0:1.1507 2:-0.1212 4:1.1507"
    chain.train_job(spark, at("bow"), at("bow"), at("scores"))
    chain.predict_job(spark, at("scores"), 2, at("classes"))
    assert chain.accuracy_job(spark, at("classes"), ["aa", "bb"]) == 100.0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_rows(spark):
    """No shuffle where doc_ids differ; repeated and null ones meet."""
    assert "Exchange" not in _plan(text.terms(docs(spark, "b a b", "", None)))
    d = spark.createDataFrame([(1, "b a b", "x"), (1, "a", "y"), (None, "c", "x"), (None, "c d", "x"), (2, "", "x"), (3, "É é", None)], "doc_id long, text string, label_name string")
    assert sorted(map(repr, map(tuple, text.terms(d).collect()))) == sorted(map(repr, [(1, "a", 2), (1, "b", 2), (None, "c", 2), (None, "d", 1), (3, "é", 2)]))
    each = [tuple(r) for r in text.terms(d, "label_name").where("doc_id = 1").collect()]
    assert sorted(each) == [(1, "x", "a", 2), (1, "x", "b", 2), (1, "y", "a", 2), (1, "y", "b", 2)]


def test_repeated_postings_are_summed(spark):
    df = spark.createDataFrame([("<a> 1,0\t1: 2;2: 3",), ("<b> 1,0\t1: 2;1: 3",), ("<c> 1,0\t1: 1",), ("<c> 1,0\t1: 4",)], "value string")
    assert sorted(map(tuple, text.postings_to_terms(index_lines(df)).collect())) == [("1", "a", 2), ("1", "b", 5), ("1", "c", 5), ("2", "a", 3)]
    assert "Exchange" not in _plan(text.postings_to_terms(index_lines(df.limit(1).localCheckpoint())))


def test_repeated_documents_match_sql(spark, tmp_path):
    """Rows of one doc_id, in train and in test, count as in SQL."""
    from corpusmill.plans import catalogue
    from tests.oracle import connect, same

    rows = [(1, "uno dos uno tres", "es"), (1, "uno dos", "es"), (2, "one two " * 6, "en"), (3, "uno two tres", "es"), (5, "uno uno", "es"), (5, "one", "en"), (10, "dos tres", "en"), (15, None, "de")]
    spark.createDataFrame(rows * 2, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("tokenize", "tf_counts", "tf_l1", "index_lines", "hash_slot_sums", "nb_sql"):
        q = catalogue.queries()[name](spark, str(tmp_path))
        same(q.distinct() if name == "nb_sql" else q, connect(str(tmp_path)), catalogue.oracle_sql()[name].replace("SELECT doc_id, prediction FROM nb", "SELECT DISTINCT doc_id, prediction FROM nb"))


def test_segmenter_holds_a_piece(spark, monkeypatch):
    """A batch of texts is cut and given on piece by piece."""
    from corpusmill import functions

    monkeypatch.setattr(functions, "PIECE", 4)
    d = docs(spark, *[f"aa {'b' * (i % 7)}" for i in range(50)]).repartition(1)
    got = text.token_arrays(d, str.split).collect()
    assert {r.doc_id: r.tokens for r in got} == {i: f"aa {'b' * (i % 7)}".split() for i in range(50)}


def test_features_leave_the_tokens_behind(spark):
    d = spark.createDataFrame([(i, ["a", "b", "b"] if i % 2 else ["b"]) for i in range(20)], "doc_id long, tokens array<string>")
    a, b = classify.counted_features(d, d, min_count=10, weight=False)
    assert a.columns == b.columns == ["doc_id", "features"]
    assert {r.doc_id: r.features.toArray().tolist() for r in a.collect()} == {i: [2.0, 1.0] if i % 2 else [1.0, 0.0] for i in range(20)}


def test_sparse_models_match_sparks(spark, monkeypatch):
    """Tree and perceptron predict as Spark's own, the forest nearly so, and none goes through Spark's dense rows."""
    from corpusmill.plans import catalogue

    seen, fit = {}, classify.fit_predict
    monkeypatch.setattr(classify, "fit_predict", lambda name, *a, **o: (seen.setdefault(name, (a, o)), a[1].withColumn("prediction", F.lit(0.0)))[1])
    for n in ("mlp", "tree", "forest"):
        catalogue.queries()[f"{n}_predict"](spark, "/root/testdata/sf0.001")
    want = {n: {r.doc_id: r.prediction for r in classify.estimator(n, **o).fit(a[0]).transform(a[1]).collect()} for n, (a, o) in seen.items()}
    monkeypatch.setattr(classify, "estimator", None)
    for n, (a, o) in seen.items():
        got = {r.doc_id: r.prediction for r in fit(n, *a, **o).collect()}
        assert got.keys() == want[n].keys() and sum(got[k] == want[n][k] for k in got) >= (0.9 if n == "RF" else 1) * len(got)


def test_tree_cuts():
    """Midpoints of all values, zero among them; of many values, those at about equal counts."""
    import numpy as np

    from corpusmill.operators.sparse import cuts

    assert cuts(np.array([1.0, 2.0]), np.array([3, 1]), 10, 31) == [0.5, 1.5]
    assert cuts(np.array([1.0, 2.0]), np.array([3, 1]), 4, 31) == [1.5]
    assert cuts(np.arange(1.0, 9), np.ones(8, int), 8, 3) == [2.5, 4.5, 6.5]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("name", ["hash_slot_sums", "tfidf_l1", "tf_l1", "tfidf", "bow_string", "bow_parse", "tf_counts", "vocab_filter_docs"])
def test_documents_in_their_rows_equal_sql(spark, tmp_path, monkeypatch, name, broadcast):
    """Repeated and null ids, empty documents and documents over many batches; with a broadcast vocabulary no row is dealt by doc_id."""
    ids = [1, 1, 2, 3, 4, 4, None, None, *range(10, 40)]
    texts = [" ".join(f"w{'xyz'[j % 3] * (1 + (i + j) % 9)}" for j in range(i * 3)) if i % 5 else ("" if i else None) for i in range(len(ids))]
    made = spark.createDataFrame([(k, t, "en") for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string")
    made.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(text, "BROADCAST_ROWS", broadcast)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = catalogue.queries()[name](spark, str(tmp_path))
        same(out, connect(str(tmp_path)), catalogue.oracle_sql()[name])
        if broadcast and name != "vocab_filter_docs":
            assert "hashpartitioning(doc_id" not in _plan(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_rows_out_of_order_are_refused():
    batch = lambda *at: pa.record_batch([pa.array(at)], names=["at"])
    got = [t.column("at").to_pylist() for t in weighting.whole_runs(iter([batch(1, 1, 2), batch(), batch(2), batch(2, 3), batch(3, 4)]))]
    assert got == [[1, 1], [2, 2, 2], [3, 3], [4]]
    with pytest.raises(ValueError):
        list(weighting.whole_runs(iter([batch(2, 1)])))


def test_classifiers_train_on_few_partitions(spark, tmp_path, monkeypatch):
    """A partition a split would send back as many arrays of the vocabulary's length."""
    at = f"{tmp_path}/rows"
    spark.range(3000).repartition(30).write.option("maxRecordsPerFile", 10).parquet(at)
    monkeypatch.setattr(classify, "PART", 1 << 30)
    spark.conf.set("spark.sql.files.openCostInBytes", "100m")
    try:
        rows = spark.read.parquet(at)
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        few = classify.gathered(rows)
        assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and few.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("name", ["tfidf_l1", "tf_l1", "tfidf", "bow_string", "bow_parse", "tf_counts", "hash_slot_sums", "nb_sql"])
def test_large_vocabularies_are_looked_up(spark, monkeypatch, name):
    """A vocabulary that is not broadcast: documents and their terms are not dealt by either, however many pieces it has."""
    d = "/root/testdata/sf0.001"
    want = rows_of(catalogue.queries()[name](spark, d))
    monkeypatch.setattr(text, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(text, "ROWS", 900)
    monkeypatch.setattr(text, "PIECE", 70)
    out = catalogue.queries()[name](spark, d)
    if name != "nb_sql":
        plan = _plan(out)
        assert "hashpartitioning(term" not in plan and "hashpartitioning(doc_id" not in plan and "BroadcastHashJoin" not in plan
    assert rows_of(out) == want


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_looked_up_keeps_rows_and_their_order():
    rows = pa.table({"at": [0, 0, 1, 2], "term": ["é", "b", None, "é"]})
    pieces = [pa.table({"term": ["a", "b"], "idf": [1.0, 2.0]}), pa.table({"term": ["é"], "idf": [3.0]})]
    assert text.looked_up(rows, pieces, "inner").to_pylist() == [{"at": 0, "term": "é", "idf": 3.0}, {"at": 0, "term": "b", "idf": 2.0}, {"at": 2, "term": "é", "idf": 3.0}]
    assert [x["idf"] for x in text.looked_up(rows, pieces[:1], "left").to_pylist()] == [None, 2.0, None, None]
    assert text.looked_up(rows.slice(2, 1), pieces, "inner").num_rows == 0


def test_forest_with_slices_that_a_tree_leaves_out(spark):
    """A tree's sample may take no row of a slice at a node; here a slice is a row."""
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, float(i % 2), Vectors.sparse(2, [i % 2], [1.0 + i])) for i in range(12)], ["doc_id", "label", "features"])
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.doc_id: r.prediction for r in classify.fit_predict("RF", rows.coalesce(1), rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {i: float(i % 2) for i in range(12)}


def test_nb_predict_counts_terms_as_its_sql(spark, tmp_path):
    """Terms used often in few rows count, single letters do not; a doc_id of two classes has a row."""
    often, many = " ".join(["rare"] * 30), " ".join(["x"] * 5)
    rows = [(1, often, "fr"), *[(i, f"{many} common", "de") for i in range(2, 40) if i % 5], *[(i, "common word", "fr") for i in range(41, 80) if i % 5]]
    rows += [(5, "rare", "fr"), (10, f"{many} word", "fr"), (15, "x x x", "es"), (20, None, "en"), (25, "rare common", "de"), (25, "rare", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    same(catalogue.queries()["nb_predict"](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.oracle_sql()["nb_predict"])


@pytest.mark.parametrize("name", ["BILR", "LR", "SVM", "MLP"])
def test_models_run_the_workloads_iterations(spark, monkeypatch, name):
    """No model stops before the 100 iterations that the workload's own models may take."""
    from inspect import signature

    seen = []
    monkeypatch.setattr(classify, "fit_predict", lambda kind, train, test, **o: (seen.append(o), test.withColumn("prediction", F.lit(0.0)))[1])
    catalogue.queries()[f"{name.lower()}_predict"](spark, "/root/testdata/sf0.001")
    assert seen[0].get("max_iter", signature(classify.estimator).parameters["max_iter"].default) == 100


def test_perceptron_starts_with_sparks_weights(spark):
    """From any place on, as Spark's model has them."""
    import numpy as np
    from pyspark.ml.common import _java2py

    from corpusmill.operators.sparse import _Random

    sc, layers = spark.sparkContext, [1500, 3]
    sizes = sc._gateway.new_array(sc._jvm.int, 2)
    sizes[0], sizes[1] = layers
    want = _java2py(sc, sc._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(7).weights()).toArray()
    random = _Random(getattr(getattr(sc._jvm.org.apache.spark.util.random, "XORShiftRandom$"), "MODULE$").hashSeed(7))
    got = np.concatenate([random.doubles(0, 1), random.doubles(1, 2999), random.doubles(3000, len(want) - 3000)])
    assert np.abs((got * 4.8 - 2.4) / 1500**0.5 - want).max() < 1e-12


def test_perceptron_leaves_long_vectors_to_tasks(spark, monkeypatch):
    """The driver holds no array of the first layer's length, here 25.6 MB; pieces of it give Spark's predictions."""
    import tracemalloc

    from pyspark.ml.linalg import Vectors

    from corpusmill.operators import sparse

    monkeypatch.setattr(sparse, "PIECE", 1 << 20, raising=False)
    n = 200_000
    rows = spark.createDataFrame([(i, float(i % 2), Vectors.sparse(n, [i % 2, 2 + i % 2, n - 1 - i], [1.0, 2.0, 3.0])) for i in range(30)], ["doc_id", "label", "features"])
    tracemalloc.start()
    try:
        got = {r.doc_id: r.prediction for r in classify.fit_predict("MLP", rows, rows, layers=[n, 16, 2], max_iter=3).collect()}
        assert tracemalloc.get_traced_memory()[1] < 12 << 20
    finally:
        tracemalloc.stop()
    assert got == {i: float(i % 2) for i in range(30)}
