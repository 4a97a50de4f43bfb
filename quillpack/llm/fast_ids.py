"""Ids of a byte-level BPE file for operators that only need them fast: the merges run inside tiktoken.

The ranks are read from the same vocabulary file; the tests hold these ids
against those of the tokenizers library and of ``quillpack.llm.bpe``.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from quillpack.llm.bpe import byte_alphabet, default_path, default_pattern


@functools.lru_cache(2)
def encoder(path: str | None = None, pattern: str | None = None):
    """A function text -> numpy array of unsigned 32-bit ids, special tokens in the text included."""
    import tiktoken

    spec, of = json.loads(open(path or default_path(), encoding="utf-8").read()), byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("file", pat_str=pattern or default_pattern(), mergeable_ranks=ranks, special_tokens=special)
    core, names = encoding._core_bpe, set(special)

    def ids(text: str) -> np.ndarray:
        return np.frombuffer(core.encode_to_tiktoken_buffer(text, names), np.uint32)

    return ids
