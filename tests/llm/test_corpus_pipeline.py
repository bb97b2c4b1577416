"""The pipeline's stages on a small corpus with one case of each kind."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnflow.llm import decontaminate, language_id, packing, queries

from brute import brute_bytes, brute_near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(12)
    prose = lambda letters, n: " ".join("".join(draw.choices(letters, k=draw.randint(3, 8))) for _ in range(n))
    rows = [(i, prose("abcdefg", 120), "aa", "s") for i in range(40)] + [(100 + i, prose("nopqrst", 120), "bb", "s") for i in range(40)]
    passage, leak = prose("abcdefg", 80), prose("abcdefg", 30)
    words = rows[3][1].split()
    words[60] = "changed"
    rows += [(200, rows[1][1], "aa", None), (201, " ".join(words), None, "s"), (202, f"{prose('abcdefg', 90)} {passage} {prose('abcdefg', 90)}", "aa", "s"), (203, f"{prose('abcdefg', 90)} {passage} {prose('abcdefg', 90)}", "aa", "s")]
    rows += [(204, f"{prose('abcdefg', 50)} {leak} {prose('abcdefg', 50)}", "aa", "s"), (205, None, None, None), (206, "123 456", "aa", "s"), (207, "", "aa", "s")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), passage


def test_stages(spark, sf_dir):
    folder, passage = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, held = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = spark.createDataFrame(stage(spark, held, folder).collect(), docs.schema)
        assert held.columns == docs.columns, name
        ids.append({r["doc_id"] for r in held.collect()})
    clean = set(range(40)) | set(range(100, 140)) | {202, 203}
    assert ids[0] == clean | {200, 201, 204}
    assert ids[1] == clean | {204} and ids[2] == ids[1] and ids[3] == clean
    texts = {r["doc_id"]: r for r in held.collect()}
    assert all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in texts.values())
    assert texts[5]["text"] == docs.where("doc_id = 5").first()["text"]
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == clean


def _languages(docs, model):
    """The ids that the language stage keeps: runs of bytes counted one by one, and the least weighted loss of a codeword."""
    mask, kept = (1 << 64) - 1, set()

    def mix(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & mask
        return x ^ x >> 33

    for i, text in docs:
        if not any(c.isalpha() for c in text or ""):
            continue
        data, counts = f" {text} ".encode(), np.zeros(language_id.BUCKETS)
        for n in language_id.ORDERS:
            for at in range(len(data) - n + 1):
                code = n
                for b in data[at : at + n]:
                    code = code << 8 | b
                counts[mix(code) % language_id.BUCKETS] += 1
        x = np.sqrt(counts)
        margin = x / np.sqrt((x * x).sum()) @ model.weights + model.bias
        p = np.exp([-(np.log1p(np.exp(-margin * word)) * model.trust).sum() for word in model.code])
        best, second = sorted(p / p.sum())[:-3:-1]
        if best - second >= language_id.AMBIGUOUS_MARGIN:
            kept.add(i)
    return kept


def _leaky(docs, items):
    """The ids of documents with a part within an item's budget, by edit distances of words over all parts at once."""
    found = set()
    for i, text in docs:
        words = decontaminate.normalise(text).split()
        for item in items:
            item = decontaminate.normalise(item).split()
            row = [0] * (len(words) + 1)
            for n, word in enumerate(item, 1):
                before, row[0] = row[0], n
                for j, w in enumerate(words, 1):
                    before, row[j] = row[j], min(before + (w != word), row[j] + 1, row[j - 1] + 1)
            if item and min(row) <= len(item) * decontaminate.ERROR_PERCENT // 100:
                found.add(i)
    return found


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept, against a plain version of it on the same rows."""
    folder, _ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    stages, held = dict(corpus_pipeline.STAGES), pairs(docs)
    model = language_id.train(docs)

    docs = spark.createDataFrame(stages["language"](spark, docs, folder).collect(), docs.schema)
    assert {i for i, _ in pairs(docs)} == _languages(held, model)

    held = pairs(docs)
    docs = spark.createDataFrame(stages["near_duplicates"](spark, docs, folder).collect(), docs.schema)
    assert pairs(docs) == [(i, t) for i, t in held if brute_near(held, 5, 80)[i][2]]

    held = pairs(docs)
    docs = spark.createDataFrame(stages["repeated_passages"](spark, docs, folder).collect(), docs.schema)
    assert [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs(docs)] == [(i, brute_bytes(held, 200)[i][3]) for i, _ in held]

    held = pairs(docs)
    docs = spark.createDataFrame(stages["benchmark_leaks"](spark, docs, folder).collect(), docs.schema)
    assert pairs(docs) == [(i, t) for i, t in held if i not in _leaky(held, items)]

    out = stages["packed"](spark, docs, folder).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.append(own.encode(t, add_special_tokens=False).ids, 2).astype("<u4") for i, t in pairs(docs)}
    cut = [(i, n, s, size) for i, x in ids.items() for n, (s, size) in enumerate(packing.pieces(len(x), 1024))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in out) == sorted(cut)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in out)
    bins = []  # one best fit over all pieces, the longest first, each into the fullest sequence with room
    for size in sorted((c[3] for c in cut), reverse=True):
        room = [b for b in bins if sum(b) + size <= 1024]
        max(room, key=sum).append(size) if room else bins.append([size])
    taken = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert taken.get(r["sequence_id"], 0) == r["offset"]
        taken[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(taken) == len(bins) and max(taken.values()) <= 1024


def test_stages_take_texts_of_blanks_and_of_one_letter(spark, sf_dir):
    texts = [" " * 1_000_000, "a" * 300_000, "\n" * 300_000, "abc " * 50_000, "漢" * 20_000]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir[0]).select("doc_id").distinct().count() >= 1, name


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ["score", "lang_pred", "ambiguous", "doc", "id", "rest", "kept", "place"]
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet").where("doc_id < 20").withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir[0])
        assert out.columns == docs.columns, name
        assert all(tuple(r)[-len(names) :] == tuple(names) for r in out.collect()), name


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir[0]).count() == 0


def test_stages_take_nulls_and_repeated_rows(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "abc", "aa", None, None), (1, "abc", "aa", None, None), (None, "abc " * 9, None, None, 1)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir[0]).count() <= 5, name


def test_texts_stay_where_no_language_is_known(spark, sf_dir):
    texts = ["some words", "пример", "", None, "12 34", "x"]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
