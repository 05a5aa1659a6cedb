"""Byte-level BPE ids of whole texts, equal to the tokenizers library's.

tiktoken runs the same vocabulary and pattern several times as fast, so it
encodes all texts but those with rare code points or special tokens, which go
through the tokenizers library. Tests hold the ids of both against each other.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from tideline.llm.textbatch import TextBatch

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on which the libraries might differ, and the start of special tokens.
UNSURE = regex.compile(r"[\p{Cn}\p{Co}\p{Cs}\p{Z}--[ ]\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|<\|", regex.V1)
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x1C, 0x20), ord("<"), 0xC2, *range(0xC8, 256)]] = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.slow = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null text."""
        b = TextBatch(texts)
        suspects = np.unique(np.searchsorted(b.stop, np.flatnonzero(_SUSPECT[b.buffer]))).tolist()
        whole = {d: self.slow.encode(texts[d], add_special_tokens=False).ids for d in suspects if UNSURE.search(texts[d])}
        encode = self.fast.encode_ordinary
        return [np.array(whole[d] if d in whole else encode(t or ""), np.uint32) for d, t in enumerate(texts)]
