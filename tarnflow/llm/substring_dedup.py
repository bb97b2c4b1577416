"""Substring dedup with suffix automata.

The automaton of a set of word sequences accepts exactly their substrings.  Reading a document through it gives, at
each word, the length of the longest suffix read so far that occurs in the set; wherever this reaches the window's
length, the window occurs in the set.  Maximal spans of such windows are removed.

The whole corpus is its own reference, in shards: the shard of an anchor (see ``_repeats``) holds the reference text
around it.  A shard's automaton is built and read in the same task, and read by those pieces only that can match
there; an automaton of every shard sent to every document would cost the square of the corpus.  Pieces come in order
of document and place; each is first read through the automaton of those before it, and then added to it, so that what
is found starts earlier.  The copies of a piece are read through the automaton once it is added, together, since they read
alike.  No word is removed that an automaton did not match.

``against_reference`` is the plain form, for a reference of bounded size: its shards' automata are broadcast, and
documents stream past them without any shuffle.

Defined cases.  Null and empty texts have no words, and nothing is removed.  Texts shorter than a window are kept; texts of
any length are read whole.  Rows of one id are ordered by a hash of their text; of equal rows one keeps its words.  Null ids
come first.  Only word sequences count: blanks between kept words are not part of the result.  An empty table gives no rows.
Other columns are not part of the result, whatever their names, unless carried along in the struct ``rest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Frame, repeated

WINDOW, GRAM = 20, 6
REFERENCE_WORDS = 2_000_000  # bound of a broadcast reference; larger ones go through ``remove_repeated``
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """A suffix automaton of several sequences; state 0 is the start."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            known = nexts[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._clone(last, known, symbol)
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = state
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = nexts[p][symbol]
                link.append(-1)  # set below: cloning appends to the lists
                link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = state

    def _clone(self, p: int, q: int, symbol) -> int:
        """A copy of q for the shorter of its strings, those that end at p followed by the symbol."""
        nexts, link = self.next, self.link
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = copy
            p = link[p]
        return copy

    def matches(self, sequence) -> Iterator[int]:
        """Matching statistics: for each symbol, the length of the longest suffix up to it that the automaton accepts."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for symbol in sequence:
            while symbol not in nexts[state]:
                if state == 0:
                    break
                state = link[state]
                matched = length[state]
            else:
                state = nexts[state][symbol]
                matched += 1
                yield matched
                continue
            matched = 0
            yield 0


def runs_of_windows(matches, window: int) -> list[tuple[int, int]]:
    """(first window, number of windows) of the runs of windows that matched; windows by their first symbol."""
    runs: list[tuple[int, int]] = []
    for end, matched in enumerate(matches):
        if matched >= window:
            start = end - window + 1
            if runs and sum(runs[-1]) == start:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((start, 1))
    return runs


def decide_by_automaton(window: int):
    """Which windows of some entries occur in an entry before them, and which in their copies."""

    def decide(entries: list[tuple[int, int, bytes]]) -> list[tuple[list, list]]:
        automaton, out = SuffixAutomaton(), []
        for _, copies, content in entries:
            words = content.split()
            before = runs_of_windows(automaton.matches(words), window)
            automaton.add(words)
            out.append((before, runs_of_windows(automaton.matches(words), window) if copies > 1 else []))
        return out

    return decide


def _cut_words(doc_id, text, words, spans) -> dict:
    kept, at = [], 0
    for start, end in spans:
        kept += words[at:start]
        at = end
    kept += words[at:]
    joined = b" ".join(kept)
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(joined).hexdigest(), "kept": joined.decode()}


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (unless turned off) kept: the words that are left, joined by one space."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def cut(*given) -> dict:
        row = _cut_words(*given)
        if not keep_text:
            del row["kept"]
        return row

    return repeated(docs, Frame("word", window, gram), decide_by_automaton(window), True, cut, schema + ", kept string" * keep_text, id_col, text_col, carry)


def against_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same columns, with what also occurs in the reference's texts removed; raises if that is over REFERENCE_WORDS."""
    words = reference.select(F.coalesce(F.sum(F.size(F.split(F.coalesce(text_col, F.lit("")), r"[ \t-\r]+"))), F.lit(0))).first()[0]
    if words > REFERENCE_WORDS:
        raise ValueError(f"the reference has about {words} words; {REFERENCE_WORDS} may be broadcast")
    texts = [r[0].encode().split() for r in reference.where(F.col(text_col).isNotNull()).select(text_col).toLocalIterator()]
    shards, size = [[]], 0
    for t in texts:
        if size + len(t) > SHARD_WORDS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(t)
        size += len(t)
    automata = []
    for shard in shards:
        automaton = SuffixAutomaton()
        for t in shard:
            automaton.add(t)
        automata.append(docs.sparkSession.sparkContext.broadcast(automaton))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols, gone = (text or "").encode().split(), set()
                for automaton in automata:
                    for start, n in runs_of_windows(automaton.value.matches(symbols), window):
                        gone.update(range(start, start + n + window - 1))
                spans = [(i, i + 1) for i in sorted(gone)]
                out.append(_cut_words(doc_id, text, symbols, spans))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
