"""Exact dedup of byte strings with suffix arrays, built by linear grouping.

``suffix_array`` sorts the suffixes of a sequence without recursion and without renaming symbols.  Suffixes begin in groups
by their first symbol.  Groups are taken in descending order: each member points to the nearest suffix before it in a
smaller group, and the suffixes pointed at move to a new group right above their old one, those pointed at more often
higher, since their common prefix (in the end their longest Lyndon prefix) has grown by this group's.  Then, from the
smallest suffix on, each sorted suffix hands out the next places in their groups to the suffixes it stands behind, found
along the same pointers.

Byte strings are matched around anchors (see ``_repeats``): pieces of text with the same anchor are aligned at it and
read as blocks of BLOCK bytes, so an array has an eighth of the bytes.  Any two equal windows are equal in all blocks
that lie within them; suffixes that agree in so many blocks stand side by side in the array, and only within such groups
windows are told apart, by the few bytes that they have besides those blocks.  All of it compares bytes, not hashes.

Defined cases.  Null and empty texts have no bytes.  Texts shorter than a window are kept; texts of any length are read whole.
Repeated rows are copies of each other: each loses what is at least a window long.  An empty table gives no rows.  Other columns
are not part of the result, whatever their names, unless carried along in the struct ``rest``.  A window may begin or end within a UTF-8 character; where
kept text is asked for, bytes that are no longer a character are left out of it, but they count as kept in the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from ._repeats import Frame, repeated

WINDOW, GRAM, BLOCK = 200, 64, 8


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of the suffixes of a sequence of positive integers, in order; the end counts as less than any symbol.

    Symbols should be dense, up to about the length of the sequence: groups are made by counting.  Nothing is sorted on the
    way but the different numbers of pointers within a group, which are fewer than the root of twice its size.
    """
    n = len(symbols)
    size_of = [0] * (max(symbols, default=0) + 1)
    for s in symbols:
        size_of[s] += 1
    start_of, at = [0] * len(size_of), 1  # place 0 is that of the empty suffix
    for s, times in enumerate(size_of):
        start_of[s] = at
        at += times
    group = [start_of[s] for s in symbols]  # a group is known by its first place
    size = [0] * (n + 1)
    ends = [0] * (n + 2)  # of each place where a group ends: which
    members: list[list[int] | None] = [None] * (n + 1)  # of each group: who is in it, in ascending order
    for s, times in enumerate(size_of):
        if times:
            g = start_of[s]
            size[g], members[g], ends[g + times] = times, [], g
    for i, g in enumerate(group):
        members[g].append(i)

    before = [-1] * n  # the nearest suffix before that is in a smaller group
    end = n + 1
    while end > 1:
        g = ends[end]
        end = g
        mine = [i for i in members[g] if group[i] == g]
        members[g] = None
        # A group is read in ascending order, and what its members point at ascends with them: so do all lists below, and with
        # them the members of new groups.
        pointed: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            moves = [list(pointed)]
        else:
            by_times: dict[int, list[int]] = {}
            for j, times in pointed.items():
                by_times.setdefault(times, []).append(j)
            moves = [by_times[times] for times in sorted(by_times, reverse=True)]
        for chosen in moves:
            by_group: dict[int, list[int]] = {}
            for j in chosen:
                by_group.setdefault(group[j], []).append(j)
            for old, moving in by_group.items():
                rest = size[old] - len(moving)
                if rest == 0:
                    continue
                new = old + rest
                ends[new + len(moving)], ends[new] = new, old
                size[old], size[new], members[new] = rest, len(moving), moving
                for j in moving:
                    group[j] = new

    array = [-1] * (n + 1)
    array[0] = n
    free = list(range(n + 1))  # of each group: its next place
    placed = bytearray(n)
    for place in range(n + 1):
        j = array[place] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            array[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return array[1:]


def ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of each 64-bit value among the different ones, from 0, and their number; by a radix sort, in linear time."""
    order = np.arange(len(values))
    for shift in (0, 16, 32, 48):
        digit = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit integers: a radix sort
    ordered = values[order]
    step = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if len(values) else order
    out = np.empty(len(values), dtype=np.int64)
    out[order] = step
    return out, int(step[-1]) + 1 if len(values) else 0


def decide_by_suffix_array(window: int, block: int = BLOCK):
    """Which windows of the entries also occur in another one, or in a copy; an entry that has copies is in the array twice."""
    whole = (window - block + 1) // block  # blocks that lie within any window, however it falls
    over = window - whole * block  # bytes of a window besides these, before or after them

    def decide(entries: list[tuple[int, int, bytes]]) -> list[tuple[list, list]]:
        which = [i for i, e in enumerate(entries) for _ in range(min(e[1], 2))]
        length = np.fromiter((len(entries[i][2]) for i in which), dtype=np.int64, count=len(which))
        place = np.fromiter((entries[i][0] for i in which), dtype=np.int64, count=len(which))
        begin = np.cumsum(length) - length
        buf = np.frombuffer(b"".join(entries[i][2] for i in which) + bytes(16), dtype=np.uint8)
        shift = ((place >> 8) & 255) % block  # blocks begin at the anchor, and before and after it
        count = (length - shift) // block
        owner = np.repeat(np.arange(len(which)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[owner] + shift[owner] + nth * block  # of each block: its first byte
        value = np.zeros(len(at), dtype=np.uint64)
        for j in range(block):
            value = (value << np.uint64(8)) | buf[at + j]
        # Entries are laid end to end, with a separator of its own after each, less than all blocks.
        rank, _ = ranks(value)
        slot = np.arange(len(at)) + owner
        symbols = np.empty(len(at) + len(which), dtype=np.int64)
        symbols[np.cumsum(count + 1) - 1] = np.arange(1, len(which) + 1)
        symbols[slot] = rank + len(which) + 1
        array = np.array(suffix_array(symbols.tolist()), dtype=np.int64)
        block_at = np.full(len(symbols), -1, dtype=np.int64)
        block_at[slot] = np.arange(len(at))

        # Neighbours in the array whose first blocks, as many as a window always holds, are the same.  Separators differ,
        # so suffixes that run into one agree with no other.
        same = np.flatnonzero(np.maximum(array[1:], array[:-1]) + whole <= len(symbols))
        for j in range(whole):
            same = same[symbols[array[same] + j] == symbols[array[same + 1] + j]]
        joined = np.zeros(max(0, len(array) - 1), dtype=bool)
        joined[same] = True
        near = np.concatenate((joined, [False])) | np.concatenate(([False], joined))
        label = np.cumsum(np.concatenate(([True], ~joined)))[near]
        first = block_at[array[near]]
        # A window begins 0 to block - 1 bytes before its first whole block.  Within a group it is told from others that begin as
        # far before by the bytes around the blocks.
        before = np.tile(np.arange(block), len(first))
        group, entry, start = np.repeat(label, block), np.repeat(owner[first], block), np.repeat(at[first], block) - before
        offset = start - begin[entry]
        fits = (offset >= 0) & (offset < (place[entry] & 255))
        before, group, entry, start, offset = before[fits], group[fits], entry[fits], start[fits], offset[fits]
        around = np.zeros((2, len(start)), dtype=np.uint64)
        for j in range(over):
            byte = buf[np.where(j < before, start + j, start + whole * block + j)]
            around[j // 8] = (around[j // 8] << np.uint64(8)) | byte
        by = np.lexsort((around[1], around[0], before, group))
        keys = np.stack((group[by], before[by], around[0][by].view(np.int64), around[1][by].view(np.int64)))
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        several = np.empty(len(by), dtype=bool)
        several[by] = np.bincount(np.cumsum(fresh) - 1, minlength=1)[np.cumsum(fresh) - 1] > 1
        # Copies of an entry have the same windows; the last one speaks for both.
        last = np.zeros(len(entries), dtype=np.int64)
        last[which] = np.arange(len(which))
        hit = several & (last[np.array(which, dtype=np.int64)[entry]] == entry)
        entry, offset = entry[hit], offset[hit]
        by = np.lexsort((offset, entry))
        entry, offset = entry[by], offset[by]
        head = np.ones(len(entry), dtype=bool)
        head[1:] = (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)
        heads = np.flatnonzero(head)
        runs: list[list[tuple[int, int]]] = [[] for _ in entries]
        for h, n in zip(heads.tolist(), np.diff(np.append(heads, len(entry))).tolist(), strict=True):
            runs[which[entry[h]]].append((int(offset[h]), n))
        return [(r, r if e[1] > 1 else []) for r, e in zip(runs, entries, strict=True)]

    return decide


def _cut_bytes(doc_id, text, data: bytes, spans) -> dict:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    left = b"".join(kept)
    return {"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(left), "n_spans": len(spans), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode("utf-8", "ignore")}


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (unless turned off) kept: what is left of the text."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(*given) -> dict:
        row = _cut_bytes(*given)
        if not keep_text:
            del row["kept"]
        return row

    return repeated(docs, Frame("byte", window, gram), decide_by_suffix_array(window), False, cut, schema + ", kept string" * keep_text, id_col, text_col, carry)
