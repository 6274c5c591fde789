"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from corpusmill.llm import fingerprints, media, mixing, packing, quality, secrets, simhash, suffixes, tokenfiles, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, __r int, length int, score double, label string, fp long, __id int, __rules int, __spans int, __key int, __taken int, __s int, __i int, __tie int, __part int, __size int, row int"
LINE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf "


def rows():
    texts = [None, "", " \n\t", "a", LINE * 3, LINE * 3, LINE.upper(), "x" * 3000, "é ü 体育 \0 " * 40, LINE * 700, "token = abcdefghijklmnop1234 " + LINE]
    out = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", None if t is None else len(t), 1, 2, 3, 0.5, "z", 9, *range(11)) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, LINE, *[None] * 20), (None, *[None] * 21)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 2)) for i in range(11)] + [(None, 1, None), (99, None, 1)], "doc_id long, quality int, toxic int")


OPS = {
    "pack": lambda d, lab: packing.pack_documents(d, BYTE),
    "quality": lambda d, lab: quality.score_documents(d, lab),
    "mix": lambda d, lab: mixing.mix(d),
    "toxic": lambda d, lab: toxicity.score_documents(d, lab),
    "secrets": lambda d, lab: secrets.report(d),
    "simhash": lambda d, lab: simhash.components(d),
    "minhash": lambda d, lab: fingerprints.fingerprint_edits(d),
    "suffixes": lambda d, lab: suffixes.report(d),
    "files": lambda d, lab: tokenfiles.round_trip(d, WORD),
    "media": lambda d, lab: media.document_media(d),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_each_have_a_result(odd, labels, name):
    got = OPS[name](odd, labels).collect()
    whole = [r for r in got if name != "pack" or r.piece == 0]
    assert sorted(str(r.doc_id) for r in whole) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPS)
def test_an_empty_table_gives_no_rows(spark, odd, labels, name):
    assert OPS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns, name
        at = f"{tmp_path}/{name}"
        out.write.parquet(at)
        docs = spark.read.schema(odd.schema).parquet(at)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
