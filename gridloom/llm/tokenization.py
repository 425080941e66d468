"""Exact, cached encoding with public tokenizer files.

A text that holds characters whose class may depend on the Unicode version is passed to the tokenizers library
whole; for others there are faster ways to the same ids. The path of the tokenizer file is always a parameter.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import regex

#: The pre-token pattern of byte-level BPE files (a fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose class is the same in every Unicode version in use: ASCII without the separators
#: 1C-1F, Latin letters, and the common typographic marks.
_STABLE = re.compile("[\t\n\r -~¡-¬®-ɏ‐-―‘-„•…€]*")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Entries of a cache; one of spans takes about 250 bytes.
CACHE_ENTRIES, SPAN_ENTRIES = 150_000, 60_000


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level files write for bytes (a fixed rule of the format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _word_pattern(path: str) -> regex.Pattern | None:
    """The pattern of pre-tokens of a file that lower-cases text and passes the pattern's matches to its model as bytes; None for others."""
    file = json.loads(Path(path).read_text())
    normal, cut = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", []), cut.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or file.get("post_processor"):
        return None
    split, level = cuts
    blanks = steps[1]["pattern"].get("Regex") == r"\s+" and steps[1]["content"] == " "
    matches = split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
    plain = not level["add_prefix_space"] and not level["use_regex"]
    return regex.compile(split["pattern"]["Regex"]) if blanks and matches and plain else None


class _Ids(dict):
    """Little-endian 32-bit ids of a field, worked out when first asked for.

    Fields of stable characters without added tokens go straight to the file's model where :func:`_word_pattern` knows
    what it gets; others go the library's whole way.
    """

    def __init__(self, tokenizer, pattern: regex.Pattern | None = None, added: re.Pattern | None = None) -> None:
        super().__init__()
        self.tokenizer, self.pattern, self.added = tokenizer, pattern, added
        self.model, self.letters = tokenizer.model, {b: c for c, b in _byte_alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if self.pattern and _STABLE.fullmatch(word) and not (self.added and self.added.search(word)):
            parts = [p.encode().decode("latin-1").translate(self.letters) for p in self.pattern.findall(word.lower())]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = found
        return found


def merge_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level file whose ids follow the order of its merges; ValueError otherwise."""
    model = json.loads(Path(path).read_text())["model"]
    alphabet = _byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, word)): i for word, i in model["vocab"].items() if all(c in alphabet for c in word)}
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"the ids of {path} don't follow its merges")
    merged = set(ids)
    return {word: i for word, i in ranks.items() if i in merged or len(word) == 1}


class ByteLevelEncoder:
    """Ids of whole texts for byte-level BPE files without a normalizer.

    Texts of stable characters are encoded by a rank table made from the file, which gives the same ids
    several times as fast; all others by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        added = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.core = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=merge_ranks(path), special_tokens={})
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    @cached_property
    def tokenizer(self):
        return load_tokenizer(self.path)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not _STABLE.fullmatch(text) or (self.added and self.added.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.core.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


class _Spans(dict):
    """Ids, begins and ends of the tokens of a field (three rows), worked out when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, field: str) -> np.ndarray:
        if len(self) >= SPAN_ENTRIES:
            self.clear()
        done = self.tokenizer.encode(field, add_special_tokens=False)
        found = np.array([done.ids, *zip(*done.offsets, strict=True)] if done.ids else np.zeros((3, 0)), dtype=np.int32)
        if len(field) <= 64:
            self[field] = found
        return found


class FieldEncoder:
    """Ids of texts for files that drop white space: fields between white space don't influence each other."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.spans = _Spans(self.tokenizer)
        added = [t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ids = _Ids(self.tokenizer, _word_pattern(path), self.added)
        self.words = np.array([self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())], dtype=object)

    def by_fields(self, text: str) -> bool:
        """Whether the fields of a text are certain to be those that the library finds."""
        return bool(_STABLE.fullmatch(text)) and not (self.added and self.added.search(text))

    def encode(self, text: str) -> bytes:
        if _STABLE.fullmatch(text):
            # As the file's normalizer does, so that words are found again in either case; added tokens are matched before it.
            low = text.lower()
            text = text if self.added and self.added.search(low) else low
        fields = re.split("[ \t\n\r]+", text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.ids.__getitem__, fields))

    def decode(self, ids: bytes) -> str:
        """As the library's decode with skip_special_tokens=False."""
        if self.tokenizer.decoder is None:
            return " ".join(self.words[np.frombuffer(ids, dtype="<u4")].tolist())
        return self.tokenizer.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder per worker process and file."""
    return ByteLevelEncoder(path)


@lru_cache(maxsize=4)
def field_encoder(path: str) -> FieldEncoder:
    """One encoder per worker process and file."""
    return FieldEncoder(path)
