"""Token ids of whole texts by a tokenizers file, each distinct stretch encoded once.

A text is cut into stretches where the pre-tokenizers of the files used here always start a new
piece: at a single space between two characters that are not white space, and between a letter,
a digit and a punctuation mark that follow each other (never beside an apostrophe). So the ids of
the stretches, laid side by side, are the ids of the text; tests compare this with encoding whole
texts. Stretches repeat so often that a dictionary of a batch is far shorter than the batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from penmark.llm.arrowtext import gather_runs, string_array, text_bytes

# Distinct stretches a worker remembers between batches; it forgets them all when full.
REMEMBERED = 500_000

_BYTES = np.arange(256)
# Kinds of ASCII characters: 1 letter, 2 digit, 3 punctuation but for the apostrophe, 0 others.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[b for b in range(0x21, 0x7F) if chr(b).isalpha()]] = 1
_KIND[[b for b in range(0x21, 0x7F) if chr(b).isdigit()]] = 2
_KIND[ord("'")] = 0
# Lead bytes of two-byte characters that are never white space.
_LEAD = (_BYTES >= 0xC3) & (_BYTES < 0xE0)
# Second bytes of the letters U+00C0..U+00FF, whose lead byte is 0xC3.
_LATIN = (_BYTES >= 0x80) & (_BYTES < 0xC0) & (_BYTES != 0x97) & (_BYTES != 0xB7)
_VISIBLE = (_BYTES >= 0x21) & (_BYTES < 0x7F)
_LOWER = _BYTES.astype(np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, from its published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Stretches:
    """Encodes texts with one tokenizer file.

    ``drop_spaces``: the file lower-cases texts and drops white space; otherwise a space belongs
    to what follows it.
    """

    def __init__(self, path: str, drop_spaces: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # The same vocabulary without normalising and cutting, for stretches that need neither.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.stand_ins = _byte_characters()
        self.drop_spaces, self.remembered = drop_spaces, remembered
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)

    def _remember(self, texts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        count = len(self.places)
        used = int(self.bounds[count])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while count + len(texts) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[used : used + len(ids)] = ids
        self.bounds[count + 1 : count + 1 + len(texts)] = used + np.cumsum(lengths)
        self.places.update(zip(texts, range(count, count + len(texts))))

    def _learn(self, texts: list[str]) -> None:
        words, others = [], []
        for text in texts:
            # One piece, unchanged by NFC and lower-casing: at most one leading space, then letters.
            word = text if self.drop_spaces else text.removeprefix(" ")
            simple = word.isalpha() and word.islower() and max(word) <= "\u00ff"
            (words if simple else others).append(text)
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            lists = [e.ids for e in found]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(lengths.sum()))
            self._remember(some, flat, lengths)
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            shown = [t.encode().decode("latin-1").translate(self.stand_ins) for t in some]
            found = self.plain.encode(" ".join(shown), add_special_tokens=False)
            lengths = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some))
            self._remember(some, np.array(found.ids, np.uint32), lengths)

    def _ends(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks over len(data) + 1 places: where a stretch ends, and spaces to leave out."""
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        kind = _KIND[data]
        latin = np.zeros(size, bool)  # second bytes of accented Latin letters
        latin[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        ending = np.where(latin, 1, kind)  # kind of the character that ends here
        starting = kind.copy()  # kind of the character that starts here
        starting[:-1][latin[1:]] = 1
        ends = edge.copy()
        a, b = ending[:-1], starting[1:]
        ends[1:-1] |= (a != b) & (a > 0) & (b > 0)
        drop = np.zeros(size, bool)
        spaces = np.flatnonzero(data == 0x20)
        spaces = spaces[(spaces >= 2) & (spaces < size - 1)]
        before, two_before, after = data[spaces - 1], data[spaces - 2], data[spaces + 1]
        sure = _VISIBLE[before] | (_LEAD[two_before] & (before >= 0x80))
        sure &= _VISIBLE[after] | _LEAD[after]
        sure &= ~(edge[spaces] | edge[spaces + 1] | edge[spaces - 1])
        drop[spaces[sure]] = True
        ends[:-1] |= drop
        return ends, drop

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch back to back, and the bounds of each text; null is empty."""
        data, bounds = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.drop_spaces:
            data = _LOWER[data]
        ends, drop = self._ends(data, bounds)
        if self.drop_spaces:
            kept = ~drop
            before = np.concatenate([[0], np.cumsum(kept)])
            data, ends, bounds = data[kept], before[np.flatnonzero(ends)], before[bounds]
        else:
            ends = np.flatnonzero(ends)
        coded = string_array(data, ends).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        if len(self.places) + len(texts) > self.remembered:
            self._forget()
        self._learn([t for t in texts if t not in self.places])
        places = np.fromiter(map(self.places.__getitem__, texts), np.int64, len(texts))
        lengths = (self.bounds[places + 1] - self.bounds[places]).astype(np.int32)
        codes = coded.indices.to_numpy()
        ids = gather_runs(self.ids, self.bounds[places][codes], lengths[codes])
        token_bounds = np.concatenate([[0], np.cumsum(lengths[codes], dtype=np.int64)])
        return ids, token_bounds[np.searchsorted(ends, bounds)]


_loaded: dict[tuple[str, bool], Stretches] = {}


def stretches(path: str, drop_spaces: bool) -> Stretches:
    """The encoder of a file, loaded once per Python worker."""
    if (path, drop_spaces) not in _loaded:
        _loaded[path, drop_spaces] = Stretches(path, drop_spaces)
    return _loaded[path, drop_spaces]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one ``end`` id after each text."""
    extra = np.arange(len(bounds))
    out = np.full(len(ids) + len(bounds) - 1, end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[(bounds + extra)[1:] - 1] = False
    out[inside] = ids
    return out, bounds + extra
