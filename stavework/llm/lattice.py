"""Unigram lattices over the words of a text: matches by Aho-Corasick, dynamic programming in numpy over many words at once.

A text is written as SentencePiece writes it (a mark in front, a mark for each space). Where no piece has a mark after another
character, and none has a newline (as in the public files), every segmentation of a text is a row of segmentations of its
units: a unit is a run of marks with the word after it or one newline, and where no piece has both letters and other characters,
units also end where letters meet other characters. Other files are cut at newlines, or not at all if pieces have
newlines. Units recur, so each is worked out once per worker while it stays in a bounded store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from .common import mix64

MARK = "▁"
UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
RUNS = re.compile(f"\n|{MARK}*[^\\W\\d_]+|{MARK}*(?:[^\\w{MARK}\n]|[\\d_])+|{MARK}+")
LINES, WHOLE = re.compile("\n|[^\n]+"), re.compile(".+", re.DOTALL)
ONE_WORD = re.compile(f"{MARK}*[^{MARK}]*", re.DOTALL)
ONE_KIND = re.compile(f"{MARK}*(?:[^\\W\\d_]*|(?:[^\\w{MARK}]|[\\d_])*)")
#: As in the tokenizer: a character that no piece covers scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
SENTINEL = -1e8


_STEP = 0x9E3779B97F4A7C15


def _prefix(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes modulo 2**64, and the inverse powers that bring a span's hash to its start."""
    n = len(points)
    up, down = np.full(n + 1, np.uint64(_STEP)), np.full(n + 1, np.uint64(pow(_STEP, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


class Vocabulary:
    """The pieces of a SentencePiece model file, read as a unigram vocabulary.

    Left out are control, unknown, unused and byte pieces (bytes serve characters that no piece covers), and without
    space_runs those with a mark after their first character. A score under SENTINEL says "never merged" in a
    byte-pair file; such a piece (the lone mark, a run of marks) takes the lowest true score, so that sums keep their precision.
    """

    def __init__(self, model: bytes, space_runs: bool = True) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) and p and (space_runs or MARK not in p[1:])]
        self.score = np.zeros(n)
        given = np.array([sp.get_score(i) for i in usable])
        self.score[usable] = np.where(given < SENTINEL, given[given >= SENTINEL].min(), given)
        self.length = np.array([len(p) for p in self.pieces])
        self.unknown_score = float(min(self.score[usable])) - UNKNOWN_PENALTY
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.said = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_id.tolist()):
            self.said[i] = bytes([b])
        used = [self.pieces[i] for i in usable]
        if any("\n" in p for p in used):
            self.pattern = WHOLE
        elif not all(map(ONE_WORD.fullmatch, used)):
            self.pattern = LINES
        else:
            self.pattern = RUNS if all(map(ONE_KIND.fullmatch, used)) else UNITS
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in usable:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.longest = int(max(self.length[usable]))
        self.piece_hashes = self._span_hashes(usable)
        self.sorted = np.argsort(self.piece_hashes)
        self.piece_hashes, self.sorted = self.piece_hashes[self.sorted], np.array(usable)[self.sorted]
        # place of a piece by the first bits of its hash; where pieces share them, a search finds the others
        self.near = np.full(1 << 22, -1, np.int32)
        self.near[self.piece_hashes >> np.uint64(42)] = np.arange(len(usable))

    def units_of(self, text: str | None) -> list[str]:
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def coded_units(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The units of all texts as places in a list of distinct units, that list, and how many units each text has.

        Where units end at marks and newlines only, these are looked for in the texts' bytes (with a space for each mark), and
        Arrow numbers the distinct ones; else the pattern finds them."""
        if self.pattern is not UNITS:
            rows = [self.units_of(t) for t in texts]
            number: dict[str, int] = {}
            codes = np.fromiter((number.setdefault(u, len(number)) for r in rows for u in r), np.int64)
            return codes, list(number), np.fromiter(map(len, rows), np.int64, len(rows))
        parts = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size)
        joined = b"".join(parts)
        data = np.frombuffer(joined, np.uint8)
        starts = data == 32
        starts[1:] &= ~starts[:-1]  # of a run of spaces the first
        newline = data == 10
        starts |= newline
        starts[1:] |= newline[:-1]
        starts[(end - size)[size > 0]] = True
        cuts = np.append(np.flatnonzero(starts), len(data))
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(joined)).dictionary_encode()
        distinct = pc.replace_substring(units.dictionary, " ", MARK).to_numpy(zero_copy_only=False).tolist()
        per_text = np.searchsorted(cuts[:-1], end) - np.searchsorted(cuts[:-1], end - size)
        return np.asarray(units.indices).astype(np.int64), distinct, per_text

    def _span_hashes(self, usable: list[int]) -> np.ndarray:
        points = np.frombuffer("".join(self.pieces[i] for i in usable).encode("utf-32-le"), np.uint32)
        end = np.cumsum(self.length[usable])
        sums, down = _prefix(points)
        start = end - self.length[usable]
        return (sums[end] - sums[start]) * down[start]

    def _by_hash(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of every piece in the text, and its id, by hashes of all short spans.

        room: characters from each position to the end of its unit. Like the automaton, but numpy all through: the automaton is
        slow at nodes with thousands of children."""
        sums, down = _prefix(points)
        at = np.flatnonzero(room > 0)
        lasts, ids = [], []
        for n in range(1, self.longest + 1):
            at = at[room[at] >= n]
            if not len(at):
                break
            h = (sums[at + n] - sums[at]) * down[at]
            place = self.near[h >> np.uint64(42)]
            near = np.flatnonzero(place >= 0)
            place, h = place[near], h[near]
            hit = self.piece_hashes[place] == h
            if len(other := np.flatnonzero(~hit)):
                place[other] = np.minimum(np.searchsorted(self.piece_hashes, h[other]), len(self.sorted) - 1)
                hit[other] = self.piece_hashes[place[other]] == h[other]
            lasts.append(at[near[hit]] + n - 1)
            ids.append(self.sorted[place[hit]])
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(lasts or empty), np.concatenate(ids or empty)

    def arcs(self, units: list[str], automaton: bool = True) -> dict[str, np.ndarray]:
        """Lattice arcs of all units, nodes being character positions in the units joined by one newline each.

        start, end: nodes. id: a piece, or -1 - code point for a character that no piece of one character covers.
        first, size: node at which each unit starts, and its length.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(size + 1) - size - 1
        joined = "\n".join(units)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if automaton:
            last, ids = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2).T
        else:
            room = np.zeros(len(points), np.int64)
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            room[np.repeat(first, size) + inside] = np.repeat(size, size) - inside
            last, ids = self._by_hash(points, room)
        start = last + 1 - self.length[ids]
        bare = np.ones(len(joined) + 1, bool)
        bare[(first + size)] = False
        bare[start[self.length[ids] == 1]] = False
        bare = np.flatnonzero(bare[:-1])
        return {
            "start": np.concatenate([start, bare]), "end": np.concatenate([last + 1, bare + 1]),
            "id": np.concatenate([ids, -1 - points[bare].astype(np.int64)]), "first": first, "size": size,
        }

    def arc_scores(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.score[np.maximum(ids, 0)], self.unknown_score)

    @staticmethod
    def arc_tokens(ids: np.ndarray) -> np.ndarray:
        """Tokens an arc becomes: one, or the UTF-8 bytes of an uncovered character."""
        c = -1 - ids
        return np.where(ids >= 0, 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))

    def best(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over every unit: the best score and the number of tokens of the best segmentation.

        Tie rule of the tokenizer: starts are taken in ascending order and only a strictly better score replaces the
        one found, so of equal scores at a node the arc from the lowest start (the longest piece) stays.
        """
        a = self.arcs(units)
        unit = np.searchsorted(a["first"], a["start"], "right") - 1
        order = np.lexsort((a["start"], a["end"], a["end"] - a["first"][unit]))
        start, end, ids = (a[k][order] for k in ("start", "end", "id"))
        depth = (a["end"] - a["first"][unit])[order]
        gain, count = self.arc_scores(ids), self.arc_tokens(ids)
        score, tokens = np.zeros(int((a["size"] + 1).sum()) + 1), np.zeros(int((a["size"] + 1).sum()) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(depth)], strict=True) if len(depth) else ():
            s = score[start[lo:hi]] + gain[lo:hi]
            e = end[lo:hi]
            heads = np.flatnonzero(np.r_[True, np.diff(e) != 0])
            top = np.maximum.reduceat(s, heads)
            width = np.diff(np.r_[heads, hi - lo])
            won = np.minimum.reduceat(np.where(s == np.repeat(top, width), np.arange(hi - lo), hi - lo), heads)
            score[e[heads]] = top
            tokens[e[heads]] = tokens[start[lo:hi][won]] + count[lo:hi][won]
        at = a["first"] + a["size"]
        return score[at], tokens[at]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of a row of token ids: marks become spaces, byte tokens bytes, the mark in front goes."""
        return self._text(b"".join(map(self.said.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)))

    def decode_lists(self, lists: pa.ListArray) -> Iterator[str]:
        """decode() of every list, one after another; the bytes are put together by Arrow."""
        said = pa.array(self.said, pa.large_binary()).take(lists.flatten())
        for row in pc.binary_join(pa.ListArray.from_arrays(lists.offsets, said), pa.scalar(b"", pa.large_binary())):
            yield self._text(row.as_py())

    @staticmethod
    def _text(out: bytes) -> str:
        return out.decode("utf-8", errors="replace").replace(MARK, " ").removeprefix(" ")
