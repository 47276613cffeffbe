"""Public tokenizers by file: ids and counts as their own library gives them.

A ``.json`` file is the tokenizers library's, a ``.model`` file sentencepiece's. For a byte-level BPE whose merge
rank equals its token id, tiktoken's merge loop is proven to give the same ids (both merge the lowest rank
first) and is used, as it is several times faster; any other file goes through its own library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The splitting pattern of byte-level BPE with ``use_regex``.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, or None unless merge rank and token id agree."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    if model.get("type") != "BPE" or any(model.get(k) not in (v, "") for k, v in plain.items()) or model.get("ignore_merges"):
        return None
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor"):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    alphabet, vocab, added = _byte_alphabet(), model["vocab"], {t["content"] for t in spec["added_tokens"]}
    for i, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab.get(left + right) != 256 + i:
            return None
    return {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}


class Encoder:
    """encode(text) -> uint32 ids. ``boundaries`` says whether chunks of a text can be spliced (see token_counts)."""

    def __init__(self, path: str):
        self.path, self.boundaries = path, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.get_piece_size()
            self._encode = lambda text: model.encode(text)
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*spec["model"]["vocab"].values(), *self.added.values()]) + 1
        ranks = _ranks(spec)
        if ranks is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda text: model.encode(text, add_special_tokens=False).ids
            return
        import tiktoken

        core = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.boundaries, self._core = not any(re.search(r"\s", t) for t in self.added), core
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.lengths = np.zeros(self.size, np.int64)  # bytes of each token
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.lengths[i] = len(token)
        self._encode = self._by_ranks

    def _by_ranks(self, text: str) -> list[int]:
        if self._split is None or not self._split.search(text):
            return self._core.encode_ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self._split.split(text)):
            out += [self.added[part]] if i % 2 else self._core.encode_ordinary(part)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encode(text), np.uint32)

    def count(self, text: str) -> int:
        return len(self._encode(text))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
