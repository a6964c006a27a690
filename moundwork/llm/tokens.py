"""Token ids of whole texts by a public tokenizer file.

The file is one of the tokenizers library (JSON), and that library's ids without special tokens are
the definition. For byte-level vocabularies whose merges are numbered in their order, tiktoken gives
the same ids from the same file at a quarter of the CPU time; it is used where a probe text agrees
in both libraries, for all texts that do not contain a special token's text. Everything else goes
through the tokenizers library. The tests compare the two on whole tables.
"""

from __future__ import annotations

import json
import os

import numpy as np

# Fixed values of byte-level vocabularies: how they split texts before merging, and the bytes that
# stand for themselves in the file (the others are numbered upwards from 256).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
PROBE = "It's  a \n\n probe: 12,345 déjà vu　\U0001F600!! <x>\tend \n "

_open: dict[str, Words] = {}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, or None where merges are not numbered in their order."""
    odd = [b for b in range(256) if b not in PLAIN]
    byte_of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(odd)}
    vocab = model.get("vocab", {})
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    special = len(merged) + 256
    try:
        return {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if i < special}
    except KeyError:
        return None


class Words:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick(path)

    def _quick(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        ranks = _ranks(spec["model"]) if plain else None
        if ranks is None:
            return None
        quick = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return quick if quick.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.quick is not None and not any(s in text for s in self.specials):
                out.append(np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes())
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def words_of(path: str) -> Words:
    """The worker's own tokenizer for a file."""
    if path not in _open:
        _open[path] = Words(path)
    return _open[path]
