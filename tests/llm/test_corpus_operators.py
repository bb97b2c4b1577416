"""The corpus operators on small tables, against brute force, and on the cases that each docstring defines."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, fingerprint, language_id, near_dedup, packing, quality, substring_dedup, suffix_dedup, url_filter, warc
from tarnflow.llm.components import components, merged

from brute import brute_bytes, brute_near, brute_words

DOCS = "doc_id long, text string"
CLASH = ["score", "doc", "kind", "path", "place", "rest", "key", "text2"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def prose(draw, words, vocabulary=400):
    return " ".join(f"w{draw.randint(0, vocabulary)}" for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages, and odd ones."""
    draw = random.Random(4)
    texts = [prose(draw, draw.randint(5, 150)) for _ in range(30)]
    passage = prose(draw, 60)
    texts += [f"{prose(draw, 30)}\n{passage} {prose(draw, 20)}" for _ in range(5)]
    texts += texts[:4]
    for t in texts[5:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, " \n\t ", "one", "One", "two words", "é" * 300, "é" * 301, "ab" * 400, "x y " * 200, passage, prose(draw, 20_000)]
    return list(enumerate(texts))


def with_clashes(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.mark.parametrize("crowd", [256, 2])
def test_repeated_word_windows(spark, corpus, monkeypatch, crowd):
    monkeypatch.setattr("tarnflow.llm._repeats.CROWD", crowd)
    df = with_clashes(spark.createDataFrame(corpus, DOCS))
    out = substring_dedup.remove_repeated(df)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()} == brute_words(corpus, 20)


@pytest.mark.parametrize("crowd", [256, 0])
def test_repeated_byte_windows(spark, corpus, monkeypatch, crowd):
    monkeypatch.setattr("tarnflow.llm._repeats.CROWD", crowd)  # 0: every anchor is split, down to single windows
    df = with_clashes(spark.createDataFrame(corpus, DOCS))
    out = suffix_dedup.remove_repeated(df, carry=True)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == brute_bytes(corpus, 200)
    assert out.select("rest.*").columns == CLASH


def test_repeats_of_repeated_rows_and_null_ids(spark):
    text = prose(random.Random(1), 50)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "short")], DOCS)
    words = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeated(df).collect())
    assert words == [(False, 1, 50), (False, 1, 50), (False, 2, 0), (True, 0, 0), (True, 0, 0)]
    cut = sorted(r["n_removed"] for r in suffix_dedup.remove_repeated(df).collect())
    assert cut == [0, 0, len(text), len(text), len(text)]


def test_every_removal_comes_from_the_index(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, DOCS)
    monkeypatch.setattr(substring_dedup, "runs_of_windows", lambda matches, window: [])
    assert substring_dedup.remove_repeated(df).where("n_removed > 0").isEmpty()
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: list(range(len(symbols))))
    assert suffix_dedup.remove_repeated(df).where("n_removed > 0").isEmpty()


def test_repeats_of_nothing(spark):
    empty = with_clashes(spark.createDataFrame([], DOCS))
    assert substring_dedup.remove_repeated(empty).count() == 0 and suffix_dedup.remove_repeated(empty, carry=True).count() == 0


def test_words_that_sums_of_powers_confuse_are_different(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    shared = " ".join(f"w{i}" for i in range(19))
    out = substring_dedup.remove_repeated(spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}")], DOCS))
    assert [r["n_removed"] for r in out.collect()] == [0, 0]
    near = near_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, other)], DOCS))
    assert sorted(r["component_id"] for r in near.collect()) == [1, 2]


def test_against_a_broadcast_reference(spark, corpus, monkeypatch):
    reference = spark.createDataFrame(corpus[30:36], DOCS)
    out = substring_dedup.against_reference(spark.createDataFrame(corpus, DOCS), reference)
    held = {tuple(w[s : s + 20]) for _, t in corpus[30:36] for w in [t.split()] for s in range(len(w) - 19)}
    for r, (_, t) in zip(sorted(out.collect()), corpus, strict=True):
        w = (t or "").encode().decode().split()
        gone = {i for s in range(len(w) - 19) if tuple(w[s : s + 20]) in held for i in range(s, s + 20)}
        assert r["n_removed"] == len(gone)
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 10)
    with pytest.raises(ValueError, match="may be broadcast"):
        substring_dedup.against_reference(spark.createDataFrame(corpus, DOCS), reference)


def test_near_duplicates(spark, cases=((4, 80), (3, 60))):
    draw = random.Random(9)
    docs = [(i, prose(draw, draw.randint(1, 60))) for i in range(40)]
    base = prose(draw, 120).split()
    for i in range(60):  # a group whose members are more or less like each other
        w = list(base)
        for at in draw.sample(range(120), draw.randint(0, 7)):
            w[at] = f"e{i}x{at}"
        docs.append((100 + i, " ".join(w)))
    docs += [(200, ""), (201, None), (202, "one"), (203, "One"), (204, "a b c"), (205, "A B C"), (206, docs[0][1].upper()), (207, prose(draw, 30_000, 9_000))]
    for k, percent in cases:
        out = near_dedup.near_duplicates(with_clashes(spark.createDataFrame(docs, DOCS)), k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()}
        expected = brute_near(docs, k, percent)
        assert got == expected


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "u"), (4, "", None)], "doc_id long, text string, kind string")
    out = near_dedup.near_duplicates(df)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out.collect()) == [(0, 0, True), (1, 0, False), (1, 0, False), (3, 3, True), (4, 4, True)]
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4]


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    test_near_duplicates(spark, ((5, 80),))


def test_large_buckets_cost_no_square(spark, monkeypatch):
    draw = random.Random(3)
    passage, base = prose(draw, 40, 9_000), prose(draw, 80, 9_000).split()
    docs = [(i, f"{passage} {prose(draw, 40, 9_000)}") for i in range(120)]  # nothing is alike but the passage
    docs += [(120 + i, f"{docs[i][1]} end") for i in range(5)]
    for i in range(120):  # some are like the base text, some like each other only, some like none
        w = list(base)
        for at in draw.sample(range(80), draw.randint(0, 4)):
            w[at] = f"e{i}x{at}"
        docs.append((200 + i, " ".join(w)))
    opened, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "written", lambda df, name: (out := write(df, name), name == "open" and opened.append(out))[0])
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()} == brute_near(docs, 4, 80)
    assert sum(-(-r["n"] // 16) for r in opened[-1].collect() if r["n"] > 16) < len(docs)  # rows that blocks of large buckets take


def test_near_duplicates_of_nothing(spark):
    empty = with_clashes(spark.createDataFrame([], DOCS))
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicated(empty).columns == empty.columns


def test_an_id_of_the_least_long_stays(spark):
    df = spark.createDataFrame([(-(1 << 63), "a b c d e f"), (5, "a b c d e f")], DOCS)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()} == {(-(1 << 63), -(1 << 63)), (5, -(1 << 63))}


def test_components(spark):
    draw = random.Random(6)
    links = [(i, i + 1) for i in range(60) if i % 20] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randint(200, 230), draw.randint(200, 230)) for _ in range(20)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {n: n for pair in links if None not in pair and pair[0] != pair[1] for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in expected and b in expected and expected[a] != expected[b]:
                expected[a] = expected[b] = min(expected[a], expected[b])
                changed = True
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    some, more = links[::2], links[1::2]
    both = merged(components(spark.createDataFrame(some, "a long, b long")), spark.createDataFrame([x for x in more if None not in x], "a long, b long"))
    assert {r["node"]: r["component"] for r in both.collect()} == expected


def test_benchmark_leaks(spark):
    draw = random.Random(3)
    items = [(i, prose(draw, n)) for i, n in enumerate((5, 8, 16, 30, 60))] + [(9, None), (10, ""), (11, "..."), (12, "A, b! c; D e f g.")]
    docs, expected = [], set()
    for n, (i, text) in enumerate(items[:5]):
        w = text.split()
        for errors in range(decontaminate.budget(len(w)) + 2):
            edited = list(w)
            for at in draw.sample(range(len(w)), errors):
                edited[at] = f"other{at}"
            doc = 100 * n + errors
            docs.append((doc, f"{prose(draw, 40)} {' '.join(edited).upper()}, {prose(draw, 40)}"))
            if errors <= decontaminate.budget(len(w)):
                expected.add((doc, i, errors))
    docs += [(900, "x A b C d -- e F g y"), (901, None), (902, ""), (903, "?!")]
    df, table = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(with_clashes(df), table).collect()}
    assert got == expected | {(900, 12, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(with_clashes(df), table).collect()) == sorted(set(d for d, _ in docs) - {d for d, _, _ in got})
    assert decontaminate.leaks(df, table.limit(0)).count() == 0 and decontaminate.clean(df, table.limit(0)).count() == len(docs)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    test_benchmark_leaks(spark)


def _labelled(draw):
    sounds = {"aa": "abcde", "bb": "fghij", "cc": "éèêàç"}
    return [(i, " ".join("".join(draw.choices(sounds[lang], k=draw.randint(2, 7))) for _ in range(draw.randint(3, 30))), lang) for i, lang in enumerate(draw.choices(list(sounds), k=150))]


def test_language_id(spark):
    known = _labelled(random.Random(8))
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame([*known, (900, None, "aa"), (901, "abc", None), (None, "fghij", "bb")], schema))
    odd = [(500, None, "aa"), (501, "", None), (502, "12 +- 34", "bb"), (503, "abcde" * 40_000, None), (None, "ghij fg", None)]
    df = spark.createDataFrame([*known, *odd], schema)
    out = {r["doc_id"]: r for r in language_id.predict(with_clashes(df), model).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in known)
    assert [out[i]["lang_pred"] for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and not any(out[i]["ambiguous"] for i in (500, 501, 502))
    mixed = spark.createDataFrame([(1, "abc fgh " * 20)], DOCS)
    assert language_id.predict(mixed, model).first()["lang_pred"] in ("aa", "bb")
    assert language_id.predict(df.limit(0), model).count() == 0
    nothing = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(df, nothing).collect()} == {"und"}
    one = language_id.train(df.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.predict(df, one).collect()} == {"und", "aa"}


def test_rare_languages_are_learned_too(spark, monkeypatch):
    # Of 300 languages, each with a word of its own, the last ones have the fewest texts.
    known = [(1000 * i + n, f"{chr(0x4E00 + i)} " * 9, f"l{i:03}") for i in range(300) for n in range(3 if i < 256 else 2)]
    df = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.languages == sorted({lang for _, _, lang in known})
    out = language_id.predict(df.select("doc_id", "lang", "text"), model).where("doc_id >= 256000").collect()
    assert len(out) == 88 and sum(r["lang_pred"] == r["lang"] for r in out) >= 80
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 300)
    assert len(language_id.train(df).languages) == 300
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 299)
    with pytest.raises(ValueError, match="299"):
        language_id.train(df)


def test_quality(spark):
    draw = random.Random(8)
    good = [(i, prose(draw, 40)) for i in range(80)]
    bad = [(100 + i, " ".join(f"{w.upper()}!!" for w in prose(draw, 40).split())) for i in range(40)] + [(200 + i, f"w{i} " * 50) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (300, None), (301, ""), (302, "w1 " * 100_000), (None, "w1 w2"), (None, "w5 w6")], DOCS)
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(300, 0), (None, 1), (1, None), (999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score(with_clashes(docs), quality.train(docs, labels)).collect()}
    assert all(out[i]["score"] > 0.5 for i, _ in good) and all(out[i]["score"] < 0.3 and out[i]["predicted"] == 0 for i, _ in bad)
    assert out[300]["score"] == out[301]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(r["score"] == 0.5 for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_fingerprints(spark, corpus):
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(with_clashes(spark.createDataFrame(corpus, DOCS))).collect()}
    for n, (i, text) in enumerate(corpus):
        own, following = text or "", corpus[(n + 1) % len(corpus)][1] or ""
        changed = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        sets = [set(fingerprint.digests([t.encode()])[0].tolist()) for t in (own, changed, following)]
        alike = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        assert [out[i]["near_edited"], out[i]["near_next"]] == pytest.approx(alike)
    same = {}
    for i, text in corpus:
        assert same.setdefault(text or "", out[i]["fingerprint"]) == out[i]["fingerprint"]
    assert len(set(same.values())) == len(same)


def test_fingerprints_of_few_and_of_equal_ids(spark):
    assert fingerprint.fingerprints(with_clashes(spark.createDataFrame([], DOCS))).count() == 0
    many = fingerprint.fingerprints(spark.createDataFrame([(None, f"text {i % 7}") for i in range(300)], DOCS).withColumn("place", F.lit(1)))
    assert many.count() == 300 and many.where("doc_id is null").count() == 300
    (one,) = fingerprint.fingerprints(spark.createDataFrame([(7, "abcd")], DOCS)).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    several = fingerprint.fingerprints(spark.createDataFrame([(2, "b"), (2, "a"), (None, "n"), (None, None), (1, "c"), (2, "a")], DOCS))
    assert several.count() == 6


def test_packing(spark, corpus):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = with_clashes(spark.createDataFrame([*corpus, (0, "again"), (None, "no id")], DOCS)).repartition(7)
    out = packing.pack(df, path).collect()
    own = Tokenizer.from_file(path)
    ids = {i: np.append(own.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4") for i, t in corpus[1:]}
    taken = {}
    for r in out:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] in ids:
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, tokens in ids.items():
        mine = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == i)
        assert [(s, n) for _, s, n in mine] == packing.pieces(len(tokens), 1024) and [p for p, _, _ in mine] == list(range(len(mine)))
    total = sum(r["length"] for r in out)
    assert len(taken) <= total / 1024 * 1.05 + 2
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_of_partitions_of_like_lengths(spark):
    import public_tokenizers

    draw = random.Random(6)
    sizes = [draw.randint(560, 640) for _ in range(2000)] + [600] * 2000 + [draw.randint(300, 400) for _ in range(4000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, " a" * (n - 1)) for i, n in enumerate(sizes)], 8), DOCS)
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == list(enumerate(sizes))
    taken = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == taken.get(r["sequence_id"], 0)
        taken[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(taken.values()) <= 1024
    assert len(taken) <= len(packing.best_fit(sizes, 1024)) * 1.002


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\nX", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u", "é" * 50_000), (6, "u", "unique"), (None, "n", "unique"), (7, "v", "unique")]
    df = with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string")).repartition(3)
    folder = f"file://{tmp_path}/archives"
    files = warc.write_archives(df, folder)
    files = spark.createDataFrame(files.collect(), files.schema)
    got = {r["id"]: r for r in warc.read_archives(files, folder).collect()}
    assert len(got) == len(pages) and sum(r["records"] for r in files.collect()) == len(pages)
    first = {}
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        r, payload = got[None if i is None else str(i)], (html or "").encode()
        assert r["digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r["payload_length"] == len(payload)
        holder = first.setdefault(payload, i)
        assert (r["type"], r["refers_to"]) == (("response", None) if holder == i else ("revisit", str(holder)))
        assert bytes(r["payload"]) == (payload if holder == i else b"")
    empty = warc.write_archives(df.limit(0), folder + "2")
    assert warc.read_archives(spark.createDataFrame(empty.collect(), empty.schema), folder + "2").count() == 0


def test_archives_of_short_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    files = warc.write_archives(df, folder, min_revisit=5)
    files = spark.createDataFrame(files.collect(), files.schema)
    assert sorted((r["id"], r["type"]) for r in warc.read_archives(files, folder).collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_url_filters(spark):
    urls = ["https://www.Example.com/en/x?q=1", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/a", "http://a.b.net/es/1#x", "http://net/fr/", "http://net", "ftp://q.org/net/es/", "//example.com/en/", "", None, "http:///en/", "http://example.com?/en/", "http://www.example.com/en/", "http://com/a://b.net/es/"]
    df = spark.createDataFrame([*enumerate(urls), (0, urls[0]), (None, urls[1])], "page_id long, url string").withColumns({c: F.lit("old") for c in ("host", "rule", "verdict", "suffix", "digest", "best", "cut")})
    out = url_filter.filter_urls(df, url_filter.rules_table(spark))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:end].lower(), rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = out.select("url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls) + 2 and all(tuple(r[1:]) == judge(r["url"]) for r in got)
    assert set(out.columns) == set(df.columns) | {"path"}
    none = url_filter.filter_urls(df, url_filter.rules_table(spark).limit(0), default="block")
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "block")}
    odd = spark.createDataFrame([("block", "org", None), ("block", None, "/"), ("allow", "org", "/ne"), ("block", "org", "/ne")], "verdict string, host string, path string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, odd).collect()}[7] == "block"
