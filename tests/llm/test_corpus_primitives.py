"""The numpy and pure Python parts, against their definitions."""

import io
import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import decontaminate, fingerprint, language_id, near_dedup, packing, quality, warc
from tarnflow.llm._features import SubwordFeatures
from tarnflow.llm._text import Words, byte_grams, grams, window_anchor
from tarnflow.llm.substring_dedup import SuffixAutomaton
from tarnflow.llm.suffix_dedup import ranks, suffix_array


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), max_size=5), st.lists(st.integers(1, 3), max_size=15))
@settings(max_examples=200, deadline=None)
def test_matching_statistics(sequences, text):
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}
    assert list(automaton.matches(text)) == [max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in parts) for i in range(len(text))]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(item, text):
    m, n = len(item), len(text)
    table = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        table[i][0] = i
        for j in range(1, n + 1):
            table[i][j] = min(table[i - 1][j - 1] + (item[i - 1] != text[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
    least = min(table[m])
    assert decontaminate.best_match(item, text) == (least, table[m].index(least))


@given(st.lists(st.text(alphabet="ab \n\té\x0b\x1c", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_bytes_split(texts):
    raw = [t.encode() for t in texts]
    w = Words(raw)
    for i, t in enumerate(raw):
        assert [w.data[w.start[j] : w.end[j]] for j in range(w.first[i], w.first[i + 1])] == t.split()
    by_word = {}
    for j in range(len(w)):
        assert by_word.setdefault(w.data[w.start[j] : w.end[j]], w.hash[j]) == w.hash[j]
    assert len(set(by_word.values())) == len(by_word)


def test_grams_and_anchors_depend_on_content_alone():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 3, 400).astype(np.uint64)
    buf = symbols.astype(np.uint8)
    for k in (1, 5, 30):
        for found, content in ((grams(symbols, k), symbols), (byte_grams(buf, k), buf)):
            seen = {}
            for i, h in enumerate(found.tolist()):
                assert seen.setdefault(content[i : i + k].tobytes(), h) == h
            assert len(set(seen.values())) == len(seen)
    window, k = 12, 3
    anchor, seen = window_anchor(grams(symbols, k), window - k + 1), {}
    for i in range(len(symbols) - window + 1):
        assert i <= anchor[i] <= i + window - k
        assert seen.setdefault(symbols[i : i + window].tobytes(), anchor[i] - i) == anchor[i] - i


def test_sketches_recover_differences():
    draw = random.Random(5)
    pool = ["".join(draw.choice("abcdef \n") for _ in range(draw.randint(0, 90))) for _ in range(60)]
    a = ["\n".join(draw.choices(pool, k=draw.randint(0, 80))) for _ in range(40)]
    b = [x if draw.random() < 0.2 else x[: len(x) // 2] + "\n" + draw.choice(pool) for x in a]
    left, right = fingerprint.Texts(a), fingerprint.Texts(b)
    row, keys, sign, cells = fingerprint.differences(left, right)
    assert set(cells.tolist()) >= {fingerprint.CELLS} and max(cells) > fingerprint.CELLS
    for i in range(len(a)):
        x, y = (set(fingerprint.digests([t.encode()])[0].tolist()) for t in (a[i], b[i]))
        assert set(keys[(row == i) & (sign > 0)].tolist()) == x - y and set(keys[(row == i) & (sign < 0)].tolist()) == y - x
    assert (fingerprint.likeness(left, left)[0] == 1).all()


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and (apart + np.eye(n) * 99).min() >= (1 if n == 2 else code.shape[1] // 5)


def test_best_fit():
    bins = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3, 4]]
    assert packing.pieces(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.pieces(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.pieces(1, 1024) == [(0, 1)]


def test_best_fit_of_counts_is_best_fit():
    draw = random.Random(2)
    for capacity in (1, 7, 30, 100):
        for _ in range(30):
            sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 300))]
            sizes += [draw.randint(1, capacity)] * draw.choice([0, 1, 500])
            runs, n = packing.best_fit_counts(Counter(sizes), capacity)
            bins = [[] for _ in range(n)]
            for size in set(sizes):
                mine = sorted(r[1:] for r in runs if r[0] == size)
                for i in range(sizes.count(size)):
                    item, first, each, offset = [r for r in mine if r[0] <= i][-1]
                    bins[first + (i - item) // each].append((offset + (i - item) % each * size, size))
            for b in bins:
                at = 0
                for offset, size in sorted(b):
                    assert offset == at
                    at += size
                assert 0 < at <= capacity
            expected = sorted(sorted(sizes[i] for i in b) for b in packing.best_fit(sizes, capacity))
            assert sorted(sorted(size for _, size in b) for b in bins) == expected


def test_tokens_are_those_of_the_vocabularys_own_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, fast = Tokenizer.from_file(path), packing.vocabulary(path)
    draw = random.Random(2)
    texts = ["", " ", "a<|endoftext|>b", "It's 12,345 — don't\n\n\tstop  now ", "x" * 3000, "Ñandú  ключ 漢字 🙂🙂", "\u00a0\u2003 \x00\x1f"]
    texts += ["".join(draw.choice("abcé '\n\t1.😀SsTt<|>") for _ in range(200)) for _ in range(200)]
    texts += [c * 200_000 for c in (" ", "\n", "a", "7", "é", " \u3000", "\x1c", "漢")] + [" " * 1_000_000, " " * 999_999 + "a", ("b" * 1000 + " " * 1000) * 50]
    assert [fast.encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert fast.own is not None


def test_long_runs_are_found():
    n = packing.LONG_RUN
    assert not any(packing.has_long_run(t.encode()) for t in ("", "a b " * n, "a" * n, (" " * n + "a") * 3, ("é" * (n // 2 - 2) + " a") * 3))
    assert all(packing.has_long_run(t.encode()) for t in (" " * (n + 1), "a " + "b" * (n + 1), "x" + "\u3000 " * n + "y", "ab " * n + "\n" * (n + 1), "漢" * n))


def test_pairs_within_the_distance_share_a_key():
    draw = np.random.default_rng(3)
    assert near_dedup.layout(80) == (64, 14)
    with pytest.raises(ValueError, match="too low"):
        near_dedup.layout(20)
    for percent in (95, 80, 60):
        symbols, chunks = near_dedup.layout(percent)
        base = draw.integers(0, 1 << 16, symbols).astype(np.uint16)
        near = np.array([base] * 200)
        for row in near:
            at = draw.choice(symbols, 2 * chunks - 1, replace=False)
            row[at] ^= 1
        keys, own = near_dedup.chunk_keys(near, chunks), near_dedup.chunk_keys(base[None, :], chunks)[0]
        assert all(np.isin(own, k).any() for k in keys)


def test_recall_of_pairs_right_at_the_similarity():
    """Of pairs of sets whose likeness is exactly the percentage, hardly any shares no key."""
    draw = np.random.default_rng(8)
    for percent, shared, own in ((80, 400, 50), (60, 300, 100)):
        symbols, chunks = near_dedup.layout(percent)
        missed = 0
        for _ in range(20):
            sets = []
            for _ in range(100):
                x = draw.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
                sets += [np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own :])))]
            keys = near_dedup.chunk_keys(near_dedup.signatures(sets, symbols), chunks)
            missed += sum(not (keys[i] == keys[i + 1]).any() for i in range(0, 200, 2))
        assert missed == 0, percent  # of 2,000


def test_exact_bounds_never_rule_out_a_near_pair():
    draw = random.Random(4)
    for _ in range(60):
        base = [draw.getrandbits(64) for _ in range(draw.choice([5, 60, 40_000]))]
        sets = [np.unique(np.array(base[: draw.randint(len(base) * 8 // 10, len(base))] + [draw.getrandbits(64) for _ in range(len(base) // draw.choice([4, 9, 30]))], dtype=np.uint64)) for _ in range(2)]
        both = len(np.intersect1d(*sets))
        if 100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both):
            n, same, histogram = [np.array([len(x)]) for x in sets], np.zeros((1, 64)), near_dedup._histogram(sets)
            assert near_dedup._may_be_near(n[0], n[1], same, same, histogram[:1], histogram[1:], 80, 14).all()


def test_ranks():
    draw = np.random.default_rng(2)
    for values in (draw.integers(0, 5, 100).astype(np.uint64), draw.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), np.empty(0, dtype=np.uint64)):
        got, n = ranks(values)
        distinct, expected = np.unique(values, return_inverse=True)
        assert n == len(distinct) and (got == expected).all()


def test_paragraphs_hold_every_byte_and_move_little():
    draw = random.Random(3)
    texts = ["", "\n", "a", "a\n", "\n\na b", " \t "] + ["".join(draw.choice("abcde é\n") for _ in range(draw.randint(0, 300))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    w, text, begin, end = fingerprint.paragraphs(raw)
    for i, t in enumerate(raw):
        assert b"".join(w.data[a:b] for a, b in zip(begin[text == i], end[text == i], strict=True)) == t
    words = [f"w{draw.randint(0, 999)}" for _ in range(200)]
    one, other = fingerprint.Texts([" ".join(words)]), fingerprint.Texts(["X" + " ".join(words)])
    assert fingerprint.likeness(one, other)[0][0] > 0.9
    turned = fingerprint.Texts(["b\na\n"])
    assert fingerprint.Texts(["a\nb\n"]).fingerprints() != turned.fingerprints()


def test_items_are_found_at_the_least_distance():
    """All parts of short texts, against all items, by brute force."""
    draw = random.Random(5)
    items = [(i, " ".join(draw.choice("abcd") for _ in range(n))) for i, n in enumerate((1, 3, 6, 7, 7, 8, 14, 14, 20, 21))]
    items += [(90, items[6][1]), (91, "")]
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    for _, item in items[6:10]:  # edited, missing and extra words
        for _ in range(12):
            w = item.split()
            for _ in range(draw.randint(1, 4)):
                at = draw.randrange(len(w))
                w[at : at + draw.randint(0, 1)] = draw.choice([[], ["x"], ["y"]])
            texts.append(" ".join([*draw.choices("abcd", k=5), *w, *draw.choices("abcd", k=5)]))

    def brute(item, text):
        least = (len(item) + 1, 0, 0)
        for start in range(len(text) + 1):
            row = list(range(len(item) + 1))
            for end in range(start, len(text) + 1):
                if end > start:
                    row = [end - start, *_next_row(row, item, text[end - 1], end - start)]
                least = min(least, (row[-1], end, start - end), key=lambda x: (x[0], x[1], -x[2]))
        return least

    def _next_row(row, item, word, first):
        out, left = [], first
        for i, w in enumerate(item):
            left = min(row[i] + (w != word), row[i + 1] + 1, left + 1)
            out.append(left)
        return out

    got = {(t, i): found for t, i, *found in decontaminate.Items(items).search([decontaminate.normalise(t) for t in texts])}
    for t, text in enumerate(texts):
        for i, item in items:
            if not item:
                continue
            distance, end, shift = brute(item.split(), text.split())
            expected = [distance, end + shift, end] if distance <= decontaminate.budget(len(item.split())) else None
            assert got.get((t, i)) == expected, (item, text)
    assert not any(i == 91 for _, i in got)


def test_decoding_is_the_least_weighted_loss():
    draw = np.random.default_rng(4)
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, draw.normal(size=(50, code.shape[1])), draw.normal(size=code.shape[1]), draw.uniform(0.5, 2, code.shape[1]))
    counts = draw.integers(0, 9, (20, 50))
    p = model.probabilities(counts)
    for row, found in zip(counts, p, strict=True):
        x = np.sqrt(row) / np.sqrt(row.sum())
        loss = [sum(t * np.log1p(np.exp(-bit * (x @ model.weights[:, j] + model.bias[j]))) for j, (bit, t) in enumerate(zip(word, model.trust, strict=True))) for word in code]
        weight = np.exp(min(loss) - np.array(loss))
        assert found == pytest.approx(weight / weight.sum(), rel=1e-4)


def test_subword_features_are_those_of_the_definition():
    texts = ["ab abc ab", "", "éa", "x y x y x", "ab"]
    f = SubwordFeatures([t.encode() for t in texts], (3, 4), 1 << 16)
    for d, text in enumerate(texts):
        words = text.split()
        own = range(f.first[d], f.first[d + 1])
        assert len(own) == len(words)
        for i, word in zip(own, words, strict=True):
            runs = [f"<{word}>"[a : a + n] for n in (3, 4) for a in range(len(word) + 3 - n)]
            assert f.begin[f.word[i] + 1] - f.begin[f.word[i]] == 1 + len(runs)
        assert [bool(f.paired[i]) for i in own] == [n > 0 for n in range(len(words))]
    a, b, _ = range(f.first[3], f.first[3] + 3)
    assert f.pair[b] == f.pair[b + 2] and f.pair[b + 1] == f.pair[b + 3] and f.pair[b] != f.pair[b + 1]


def test_scores_are_the_softmax_of_the_mean_vector():
    draw = np.random.default_rng(5)
    model = quality.Model(draw.normal(size=(2 * quality.BUCKETS, quality.DIMENSIONS)), draw.normal(size=(quality.DIMENSIONS, 2)), draw.normal(size=2))
    by_bucket, bias = model.collapsed()
    bucket, times = draw.integers(0, 2 * quality.BUCKETS, 30), draw.integers(1, 5, 30)
    z = (times @ model.vectors[bucket] / times.sum()) @ model.layer + model.bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert 1 / (1 + np.exp(-(times @ by_bucket[bucket] / times.sum() + bias))) == pytest.approx(p[1])


def test_dictionary_is_drawn_from_the_whole_archive():
    draw = random.Random(3)
    noise = [warc.record("response", str(i), "http://x/", "D", draw.randbytes(4000)) for i in range(700)]
    shared = draw.randbytes(3000)
    like = [warc.record("response", str(i), "http://x/", "D", shared + draw.randbytes(100)) for i in range(2000)]
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in noise + like:
        writer.write(r)
    writer.close()
    assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == noise + like
    assert len(out.getvalue()) < sum(map(len, noise)) + sum(map(len, like)) / 4


def test_archive_round_trip():
    draw = random.Random(1)
    records = [warc.record("response", str(i), "http://x/", "D", bytes(draw.choices(b"abcd <p>", k=draw.randint(0, 4000)))) for i in range(300)]
    for some in (records, records[:2], []):
        out = io.BytesIO()
        writer = warc.ArchiveWriter(out)
        for r in some:
            writer.write(r)
        writer.close()
        assert struct.unpack("<I", out.getvalue()[:4])[0] == warc.SKIPPABLE_MAGIC
        assert list(warc.read_archive(io.BytesIO(out.getvalue()), 777)) == some
    cut = io.BytesIO(out.getvalue()[:4] + b"\xff")
    with pytest.raises((ValueError, struct.error)):
        list(warc.read_archive(cut))
