"""Token ids of whole texts with the tokenizers library, one call for each new piece of text.

A text is cut where no pre-token of either vocabulary can reach across: before a space that a
non-space follows, where letters, digits and ASCII marks (but the apostrophe) meet, and around a line
break. Its ids are those of its pieces put together. Each step takes the different pieces of a slice
of texts, looks up those met before, and has the library encode the others, many in one call; ids
are then gathered for all places at once.

A text that holds the string of a special token is one piece: the library splits it at those strings
before anything else.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

from tesserae.llm.common import held

#: Pieces that a Python worker keeps for its further slices, and the longest piece kept; others are encoded for each slice anew.
KEPT_PIECES, KEPT_BYTES = 150_000, 64
#: Texts are encoded in steps of about so many bytes.
STEP_BYTES = 3_000_000
#: Pieces that one call of the library encodes as one text.
JOINED = 1000

_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(128) if chr(c).isdigit()]] = _DIGIT
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True
#: Bytes after which a space surely has a non-space: ASCII, and leads of characters of which none is white space.
_FOLLOWS = _SOLID.copy()
_FOLLOWS[0xC3:0xE1] = True
_FOLLOWS[0xE4:0xF5] = True


def encoder_of(path: str, end_id: int, kept: int = KEPT_PIECES) -> PieceEncoder:
    """This process's encoder: a worker runs many tasks, and the pieces it keeps serve all of them."""
    return held((path, end_id, kept), lambda: PieceEncoder(path, end_id, kept))


def valid(text: bytes) -> bytes:
    """text with U+FFFD in place of what is not UTF-8, as in every operator that takes characters."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()
    return text


def boundaries(data: np.ndarray) -> np.ndarray:
    """For each place in UTF-8 text (and its end), whether it can be cut there."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF are letters, except for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(data) + 1, dtype=bool)
    before, now = kind[:-1], kind[1:]
    cut[1:-1] = (before != now) & (before != 0) & (now != 0)
    space = np.flatnonzero(data[:-1] == 32)
    cut[space[_FOLLOWS[data[space + 1]]]] = True
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[_SOLID[data[line - 1]]]
    cut[line] = True
    cut[line[_SOLID[data[line + 1]]] + 1] = True
    return cut


class PieceEncoder:
    """Ids of texts, each followed by end_id; path: a tokenizers file."""

    def __init__(self, path: str, end_id: int, kept: int = KEPT_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [(t.content.lower() if t.normalized else t.content, t.normalized) for t in special]
        self.kept = kept
        self.places: dict[bytes, int] = {}  # of pieces in the arrays below
        self.ids, self.lengths = np.array([end_id], dtype="<u4"), np.array([1])  # place 0 is the end id

    def _whole(self, texts: list[bytes], joined: bytes) -> list[int]:
        """Texts that hold the string of a special token."""
        have = [(c.encode(), n) for c, n in self.special]
        if not any(c in (joined.lower() if n else joined) for c, n in have):
            return []
        return [i for i, t in enumerate(texts) if any(c in (t.lower() if n else t) for c, n in have)]

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces that are not kept."""
        texts = [p.decode() for p in pieces]
        # a space and letters are one pre-token, which can stand next to any other such piece
        joins = np.fromiter((t[:1] == " " and t[1:].isalpha() for t in texts), dtype=bool, count=len(texts))
        lengths = np.zeros(len(texts), dtype=np.int64)
        led, other, ids_of_led = np.flatnonzero(joins), np.flatnonzero(~joins).tolist(), []
        for a in range(0, len(led), 20 * JOINED):
            groups = [led[x : x + JOINED] for x in range(a, min(a + 20 * JOINED, len(led)), JOINED)]
            got = self.tokenizer.encode_batch(["".join([texts[i] for i in g.tolist()]) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, got, strict=True):
                n = np.bincount(np.array(e.word_ids), minlength=len(g))
                if len(n) != len(g) or not n.all():  # a letter to Python and none to the library
                    joins[g] = False
                    other += g.tolist()
                else:
                    lengths[g] = n
                    ids_of_led.append(np.array(e.ids, dtype="<u4"))
        other.sort()
        rest = []
        for a in range(0, len(other), 10_000):
            for i, e in zip(other[a : a + 10_000], self.tokenizer.encode_batch_fast([texts[i] for i in other[a : a + 10_000]], add_special_tokens=False), strict=True):
                rest.append(e.ids)
                lengths[i] = len(rest[-1])
        ids = np.zeros(int(lengths.sum()), dtype="<u4")
        mine = np.repeat(joins, lengths)
        if ids_of_led:
            ids[mine] = np.concatenate(ids_of_led)
        if rest:
            ids[~mine] = np.concatenate([np.array(x, dtype="<u4") for x in rest])
        return ids, lengths

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all texts' ids in one array, end ids included, and where each text's ids end."""
        import pyarrow as pa

        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        texts = [valid(t) for t in texts]
        joined = b"".join(texts)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        if joined:
            data = np.frombuffer(joined, dtype=np.uint8)
            cut = boundaries(data)
            for i in self._whole(texts, joined):
                cut[at[i] : at[i + 1]] = False
            cut[at] = True
            begin = np.flatnonzero(cut)
            column = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
            pieces, which = column.dictionary.to_pylist(), column.indices.to_numpy()
            place = np.fromiter(map(self.places.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
            unknown = np.flatnonzero(place < 0)
            new_ids, new_lengths = self._new([pieces[i] for i in unknown.tolist()])
            place[unknown] = len(self.lengths) + np.arange(len(unknown))
            ids, lengths = np.concatenate((self.ids, new_ids)), np.concatenate((self.lengths, new_lengths))
            # each text's pieces, then the end id
            after = np.searchsorted(begin, at[1:])
            order = np.insert(place[which], after, 0)
            self._keep([pieces[i] for i in unknown.tolist()], new_ids, new_lengths)
        else:
            ids, lengths = self.ids, self.lengths
            after, order = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        n = lengths[order]
        total = np.cumsum(n)
        picked = np.repeat(starts[order] - (total - n), n) + np.arange(total[-1])
        return ids[picked], total[after + np.arange(len(texts))]

    def _keep(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        room = self.kept - len(self.places)
        if room <= 0:
            return
        short = np.flatnonzero(np.array([len(p) <= KEPT_BYTES for p in pieces], dtype=bool))[:room]
        for k, i in enumerate(short.tolist(), start=len(self.lengths)):
            self.places[pieces[i]] = k
        chosen = np.zeros(len(pieces), dtype=bool)
        chosen[short] = True
        self.ids = np.concatenate((self.ids, ids[np.repeat(chosen, lengths)]))
        self.lengths = np.concatenate((self.lengths, lengths[short]))
