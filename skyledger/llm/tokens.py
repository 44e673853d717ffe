"""Token ids from a `tokenizers` file, looked up once per distinct piece of a slice of texts.

Both kinds of vocabulary break text before a space that a non-space follows,
between ASCII letters or digits and ASCII punctuation other than the apostrophe,
and around the last line feed before a letter, so what stands between two such
places is encoded alike wherever it stands. Texts that hold a special token's
string go to the tokenizer whole. The places are found in the joined bytes of a slice. Equal pieces are found by
sorting: up to sixteen bytes are compared as two integers and a length, exactly,
and longer pieces as bytes. Only distinct pieces are looked up, and those not met
lately go to the tokenizer, many in one string with a special token between them,
which the library cuts out before it does anything else.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from skyledger.llm.words import mix

_SHORT = 16
#: Pieces that go to the tokenizer in one string.
_TOGETHER = 256
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n\t")] = True
#: ASCII letters and digits, ASCII punctuation other than the apostrophe, and both with it.
_WORD, _MARK, _GRAPH = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_GRAPH[33:127] = True
_WORD[[b for b in range(33, 127) if chr(b).isalnum()]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
#: What may begin a white-space character, so that a space before it is no place to break:
#: ASCII white space, and the first bytes of U+0085, U+00A0, U+1680, U+2000-205F and U+3000.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class PieceEncoder:
    """Encodes whole texts to little-endian id bytes of ``width`` bytes each.

    ``keeps_space``: the vocabulary has spaces inside its tokens (byte-level
    kind); otherwise white space only separates words.
    """

    def __init__(self, definition: str, keeps_space: bool, generation: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.keeps_space = keeps_space
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.dtype = np.dtype(f"<u{self.width}")
        self.generation = generation
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        # Where the file lower-cases anyway, words that differ in ASCII case only are one piece.
        self.folds = not keeps_space and self._ids("ABC XYZ") == self._ids("abc xyz")
        special = [(i, t.content) for i, t in added.items() if t.special]
        # A special token that stands between two pieces and comes back as one id.
        self.mark_id, self.mark = next(
            ((i, t) for i, t in special if self._ids("a" + t + " b") == [*self._ids("a"), i, *self._ids(" b")]), (None, None)
        )

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    # -- pieces ---------------------------------------------------------------

    def _places(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Joined bytes, begin and end of every piece, and the first piece of every text (n + 1)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"\n".join(texts) + b"\n"
        if self.folds:
            joined = joined.lower()
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        word, mark = _WORD[data], _MARK[data]
        cut = np.zeros(data.size + 1, bool)
        cut[1:-1] = (word[:-1] & mark[1:]) | (mark[:-1] & word[1:])
        if self.keeps_space:
            feed = data == 10
            last = feed[:-1] & word[1:]
            cut[:-2] |= ((data[:-1] == 32) & ~_MAY_BE_SPACE[data[1:]]) | last
            cut[1:-1] |= last | (_GRAPH[data[:-1]] & feed[1:])
            inside = np.ones(data.size + 1, bool)
            inside[begins + sizes] = False  # the line feeds that join the texts are in no piece
            cut &= inside
            cut[begins] = True
            starts = np.flatnonzero(cut)
            stops = np.append(starts[1:], data.size)
            joint = np.searchsorted(starts, begins[1:]) - 1
            stops[joint] -= 1
            stops[-1] -= 1
            full = stops > starts
            starts, stops = starts[full], stops[full]
        else:
            blank = _BLANK[data]
            solid = ~blank
            cut[1:-1] |= solid[1:] & blank[:-1]
            cut[0] = True
            starts = np.flatnonzero(cut[:-1] & solid)
            # A piece ends where the next one begins or at the next blank.
            next_blank = np.flatnonzero(blank)
            stops = np.minimum(next_blank[np.searchsorted(next_blank, starts)], np.append(starts[1:], data.size))
        return joined, starts, stops, np.append(np.searchsorted(starts, begins), starts.size)

    @staticmethod
    def _alike(joined: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one piece of each kind, kind of every piece); pieces of a kind have equal bytes."""
        data = np.frombuffer(joined + bytes(_SHORT), np.uint8)
        eight = np.ndarray((data.size - 7,), "<u8", buffer=data.data, strides=(1,))
        size = stops - starts

        def masked(at: int) -> np.ndarray:
            left = np.clip(size - at, 0, 8).astype(np.uint64)
            ones = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
            return eight[np.minimum(starts + at, eight.size - 1)] & ones

        low, high = masked(0), masked(8)
        key = mix(low ^ mix(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        low, high, size_, key = low[order], high[order], size[order], key[order]
        # Where keys collide neighbours differ, which gives more kinds than needed and no wrong one.
        new = np.ones(order.size, bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size_[1:] != size_[:-1]) | (size_[1:] > _SHORT)
        kind = np.empty(order.size, np.int64)
        kind[order] = np.cumsum(new) - 1
        return order[new], kind

    # -- ids ------------------------------------------------------------------

    def _encode_new(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8") for p in pieces]
        together = range(len(texts)) if self.mark else ()
        if not self.mark:
            for piece, found in zip(pieces, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                self.recent[piece] = array(self.code, found.ids).tobytes()
        groups = [together[k : k + _TOGETHER] for k in range(0, len(together), _TOGETHER)]
        joined = [self.mark.join([texts[k] for k in group]) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            marks = np.flatnonzero(ids == self.mark_id)
            if marks.size != len(group) - 1:
                raise ValueError("the tokenizer does not keep the special token apart")
            data, width = ids.tobytes(), self.width
            begins = [0, *((marks + 1) * width).tolist()]
            ends = [*(marks * width).tolist(), len(data)]
            for k, begin, end in zip(group, begins, ends):
                self.recent[pieces[k]] = data[begin:end]

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.recent) > self.generation:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = []
        for piece in pieces:
            if piece not in recent:
                known = older.get(piece)
                if known is None:
                    new.append(piece)
                else:
                    recent[piece] = known
        if new:
            self._encode_new(list(dict.fromkeys(new)))
        return [recent[piece] for piece in pieces]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8)."""
        whole = [k for k, t in enumerate(texts) if any(x in t for x in self.special)]
        if whole:
            found = self._by_piece([b"" if any(x in t for x in self.special) else t for t in texts])
            for k in whole:
                found[k] = array(self.code, self._ids(texts[k].decode("utf-8"))).tobytes()
            return found
        return self._by_piece(texts)

    def _by_piece(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        joined, starts, stops, of_text = self._places(texts)
        if not starts.size:
            return [b""] * len(texts)
        chosen, kind = self._alike(joined, starts, stops)
        bounds = zip(starts[chosen].tolist(), stops[chosen].tolist())
        found = self._looked_up([joined[begin:end] for begin, end in bounds])
        flat = np.frombuffer(b"".join(found), self.dtype)
        count = np.array([len(x) for x in found], np.int64) // self.width
        first = np.cumsum(count) - count
        each = count[kind]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[kind] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        at = (np.concatenate([[0], ends])[of_text] * self.width).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


_encoders: dict[tuple[int, int, bool], PieceEncoder] = {}


def shared_encoder(definition: str, keeps_space: bool) -> PieceEncoder:
    """The worker process's encoder for this vocabulary, so tasks share its cache."""
    key = (len(definition), hash(definition), keeps_space)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(definition, keeps_space)
    return _encoders[key]
