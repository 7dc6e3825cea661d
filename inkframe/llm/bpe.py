"""Token ids and counts of a public tokenizer, equal to the library's.

Counts: texts of plain Latin characters are cut by the documented pre-token pattern, and pieces that are no whole token go
to the library's own merge model. Ids: where the merges of the file stand in the order of its ids, the vocabulary is also a
table of ranks, which tiktoken merges several times faster to the same ids. Any other file or text, and one with a run of
thousands of blanks, goes to the library whole, so results are the library's in every case.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: The pre-token pattern of byte-level BPE, for texts that hold only the characters of `PLAIN`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN = r"\t\n\r\x20-\x7e¡-©«-±´-¸»¿-ɏ"

RANKED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_FIND = re.compile(PATTERN).findall
_ODD = re.compile(f"[^{PLAIN}]").search
#: Runs of white space that the ranked encoder's pattern may not get, as it recurses for each character, and how they are found:
#: a slice of SPOT characters at every STRIDE lies whole in any run of STRIDE + SPOT.
STRIDE, SPOT = 5_000, 32
#: Entries of one generation of a cache (there are two), and the longest text that enters it.
ENTRIES, LONGEST = 200_000, 48


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class Memo(dict):
    """A dictionary that makes a missing value. When full it keeps what is asked for again from its last generation."""

    def __init__(self, make: Callable, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.fixed, self.last = make, fixed or {}, {}
        self.room = ENTRIES + len(self.fixed)

    def __missing__(self, key: str):
        value = self.last.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.room:
                self.last = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value


def is_byte_bpe(path: str) -> bool:
    """Whether a file is plain byte-level BPE, for which pieces can be merged apart from each other."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre, model = j.get("pre_tokenizer") or {}, j["model"]
    return (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        and not j.get("normalizer") and not j.get("truncation") and not j.get("padding")
        and model["type"] == "BPE" and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in j.get("added_tokens", []))
    )


def in_rank_order(path: str) -> bool:
    """Whether the file's merges make its ids in order after the 256 bytes, so that an id is the rank of its merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    return sorted(model["vocab"][c] for c in byte_letters()) == list(range(256)) and ids == list(range(256, 256 + len(ids)))


def not_whole(path: str) -> list[int]:
    """The ids whose own strings do not encode alone as that one token: the proof of the whole-token shortcut.

    Every string of the vocabulary goes through the merges once; the shortcut may count all but those returned.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    return sorted(i for s, i in tokenizer.get_vocab(with_added_tokens=False).items() if [t.id for t in model.tokenize(s)] != [i])


def long_blank(text: str) -> bool:
    """Whether a text may hold a run of white space that is too long for the ranked encoder. A shorter run may be told too."""
    return len(text) > STRIDE and any(text[k:k + SPOT].isspace() for k in range(0, len(text) - SPOT, STRIDE))


class Encoder:
    """Ids and counts of one tokenizer file, for use inside one task."""

    def __init__(self, path: str, unproven: list[int] | None = None):
        self.path = path
        self.plain = is_byte_bpe(path)
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not self.plain:
            return
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.merge = self.tokenizer.model.tokenize
        byte = {c: i for i, c in self.letters.items()}
        ranks = {bytes(map(byte.__getitem__, s)): i for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} if unproven is None and in_rank_order(path) else {}
        self.ranked = None
        if len(ranks) > 256:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=RANKED, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if unproven is not None:
            bad, whole = set(unproven), {}
            for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                if i not in bad:
                    try:
                        whole[bytes(map(byte.__getitem__, s)).decode()] = 1
                    except (UnicodeDecodeError, KeyError):
                        continue
            self.counts = Memo(lambda piece: len(self.merge(self._letters(piece))), whole)

    def _letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.plain or _ODD(text):
            ids = self.pieces.encode(text) if self.path.endswith(".model") else self._library(text)
            return np.array(ids, "<u4").tobytes()
        parts = self._parts(text)
        if len(parts) > 1:
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain_ids(p) for p in parts)
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        return np.array(self.ranked(text) if self.ranked and not long_blank(text) else self._library(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        """The number of ids; pieces that are whole tokens count one, only the rest is merged."""
        if self.path.endswith(".model"):
            return len(self.pieces.encode(text))
        if not self.plain or _ODD(text):
            return len(self._library(text))
        parts = self._parts(text)
        if len(parts) > 1:
            return sum(1 if p in self.special else sum(map(self.counts.__getitem__, _FIND(p))) for p in parts)
        return sum(map(self.counts.__getitem__, _FIND(text)))


_ENCODERS: dict = {}


def encoder(path: str, unproven: tuple[int, ...] | None = None) -> Encoder:
    """The encoder of this Python process for a file; caches stay warm between tasks."""
    key = (path, unproven)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, None if unproven is None else list(unproven))
    return _ENCODERS[key]
