"""Token ids of texts, by the tokenizers library and the file of a public byte-level BPE.

Encoding whole texts costs about a microsecond a character, nearly all of it for words met before.
So texts are cut into pieces at places where the byte-level pre-tokenizer always cuts, and each
worker looks the pieces of a run of texts up together, in a table of fixed size with the ids of
pieces met before; only new pieces go to the library.  Where a cut isn't certain there is none: the
piece is then longer, never wrong.
"""

from __future__ import annotations

import os
import re

import numpy as np

from pairloom.llm.common import _VALUES, _powers, mix

#: Places of the table and ids that a place holds; pieces with more ids are encoded each time.
PLACES, WIDTH = 1 << 21, 8

# Kinds of bytes: letter, digit, mark, apostrophe, space, other ASCII white space, anything else.
LETTER, DIGIT, MARK, QUOTE, SPACE, BLANK, OTHER = range(7)


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 128 or 0x1C <= b <= 0x1F:
        return OTHER
    if c.isalpha():
        return LETTER
    if c.isdigit():
        return DIGIT
    return {" ": SPACE, "'": QUOTE}.get(c, BLANK if c.isspace() else MARK)


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
_BASE2 = 0x9E6C63D0876A9A47


def default_path() -> str:
    """The place of the tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def kinds_of(flat: np.ndarray) -> np.ndarray:
    """The kind of each byte; U+00C0 to U+017F but the two signs among them are letters."""
    kind = _KINDS[flat]
    lead = np.flatnonzero((flat >= 0xC3) & (flat <= 0xC5))
    tail = flat[lead + 1]
    lead = lead[(flat[lead] != 0xC3) | (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cuts_of(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin, in the bytes of texts with the offsets ``at``."""
    sure = kind <= QUOTE  # not white space in any case
    after = np.empty(len(kind), bool)  # the next byte of the text is sure
    after[:-1] = sure[1:]
    after[at[1:][np.diff(at) > 0] - 1] = False
    cut = np.zeros(len(kind), bool)
    before, here = kind[:-1], kind[1:]
    # the last of a run of white space is cut off where other text follows
    cut[1:] = ((here == SPACE) | (here == BLANK)) & (sure[:-1] | after[1:])
    cut[1:] |= sure[1:] & (before == BLANK)
    # two kinds side by side; a mark and an apostrophe are one run, and an apostrophe may take letters
    cut[1:] |= sure[1:] & sure[:-1] & (before != here) & (before != QUOTE) & ~((before == MARK) & (here == QUOTE))
    cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of runs of texts.  One for each worker and file: see ``encoder``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: the letter that stands for each byte, for the bytes of single runs
        self.shown = {b: split.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for c in map(chr, range(0xC0, 0x180)):
            self.shown |= dict(zip(c.encode(), split.pre_tokenize_str(c)[0][0], strict=True))
        self.names = [np.zeros(PLACES, np.uint64) for _ in range(2)]
        self.n = np.zeros(PLACES, np.uint8)
        self.ids = np.zeros((PLACES, WIDTH), np.uint32)

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        if self.special.search(flat):  # such a token may cross pieces
            ids = [self._one(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        return self._run(flat, at)

    def _one(self, flat: np.ndarray) -> np.ndarray:
        if self.special.search(flat):
            return np.array(self.direct(flat.tobytes().decode()), np.uint32)
        return self._run(flat, np.array([0, len(flat)]))[0]

    def _run(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        kind = kinds_of(flat)
        start = cuts_of(kind, at)
        end = np.append(start[1:], len(flat))
        one, two = (self._names(flat, start, end, base) for base in (0xD1342543DE82EF95, _BASE2))
        place = (one & np.uint64(PLACES - 1)).astype(np.int64)
        known = (self.names[0][place] == one) & (self.names[1][place] == two)
        n = self.n[place].astype(np.int64)
        rows = self.ids[place]
        if not known.all():
            self._learn(flat, kind, start, end, one, two, place, np.flatnonzero(~known), n, rows, long := {})
        else:
            long = {}
        before = np.concatenate([[0], np.cumsum(n)])
        took = rows[np.arange(WIDTH) < np.where(n > WIDTH, 0, n)[:, None]]
        if long:
            ids, short = np.empty(before[-1], np.uint32), np.ones(before[-1], bool)
            for k, own in long.items():
                ids[before[k] : before[k + 1]] = own
                short[before[k] : before[k + 1]] = False
            ids[short] = took
        else:
            ids = took
        return ids, np.diff(before[np.searchsorted(start, at)])

    @staticmethod
    def _names(flat: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """A 64-bit name of each piece; two of them tell pieces apart."""
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_VALUES[flat] * _powers(len(flat), base), out=sums[1:])
        value = (sums[end] - sums[start]) * _powers(len(flat), pow(base, -1, 1 << 64))[start]
        return mix(value + (end - start).astype(np.uint64))

    def _learn(self, flat, kind, start, end, one, two, place, new, n, rows, long) -> None:
        """Encode the pieces that the table lacks, each once, and keep them."""
        _, first, which = np.unique(one[new], return_index=True, return_inverse=True)
        a, b = start[new[first]], end[new[first]]
        body = np.minimum(a + (kind[a] == SPACE), b - 1)
        changes = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        single = (kind[body] <= MARK) & (changes[body] == changes[b - 1])
        raw, shown, model, made = flat.tobytes(), self.shown, self.tokenizer.model, []
        for i, j, alone in zip(a.tolist(), b.tolist(), single.tolist(), strict=True):
            if alone:  # one run of letters, digits or marks: the pre-tokenizer leaves it whole
                made.append([t.id for t in model.tokenize(raw[i:j].decode("latin-1").translate(shown))])
            else:
                made.append(self.direct(raw[i:j].decode()))
        size = np.array([len(x) for x in made])
        padded = np.zeros((len(made), WIDTH), np.uint32)
        flat_ids = np.fromiter((t for x in made if len(x) <= WIDTH for t in x), np.uint32)
        padded[np.arange(WIDTH) < np.where(size > WIDTH, 0, size)[:, None]] = flat_ids
        n[new], rows[new] = size[which], padded[which]
        for k in np.flatnonzero(size[which] > WIDTH):
            long[int(new[k])] = made[which[k]]
        keep = first[size <= WIDTH]
        at = place[new[keep]]
        self.names[0][at], self.names[1][at] = one[new[keep]], two[new[keep]]
        self.n[at], self.ids[at] = size[size <= WIDTH], padded[size <= WIDTH]
        # two new pieces may share a place: only what was written last may answer for it
        kept = self.names[0][at] == one[new[keep]]
        if not kept.all():
            wrong = at[~kept]
            self.names[0][wrong] = self.names[1][wrong] = 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
