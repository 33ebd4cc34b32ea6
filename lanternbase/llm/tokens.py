"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Where the file's ids ascend in the order of its merges, ``tiktoken`` over the same vocabulary gives the
same ids several times faster. It encodes the texts of plain characters, on whose classes both libraries agree; all
others, and those that contain an added token's string, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

#: The regular expression of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of plain texts: ASCII without most control characters, and Latin letters.
_plain = np.zeros(256, bool)
_plain[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def token_bytes(spec: dict) -> dict[bytes, int]:
    """Token to id, of a byte-level vocabulary without its added tokens."""
    letters, added = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


class Encoder:
    """ids(texts): flat ids and the number of ids of each text, as ``tokenizers`` gives them without special tokens."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        """A ``tiktoken`` encoding of the same vocabulary, if ids ascend in the order of the merges."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
        if not usual or model.get("ignore_merges") or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        import tiktoken

        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=token_bytes(spec), special_tokens={})

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts: a string array; null counts as empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        docs = [x or "" for x in texts.to_pylist()]
        raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        slow = np.full(len(docs), self.fast is None)
        if self.fast is not None:
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            joined = b"".join(raw)
            slow[np.searchsorted(ends, np.flatnonzero(~_plain[np.frombuffer(joined, np.uint8)]), side="right")] = True
            for special in self.added:
                if special in joined:
                    slow |= np.array([special in d for d in raw])
        lists = [[] if s else self.fast.encode_ordinary(d) for d, s in zip(docs, slow, strict=True)]
        at = np.flatnonzero(slow)
        for i, e in zip(at, self.tokenizer.encode_batch_fast([docs[i] for i in at], add_special_tokens=False), strict=True):
            lists[i] = e.ids
        return np.concatenate([np.array(x, np.uint32) for x in lists]), np.fromiter(map(len, lists), np.int64, len(lists))


_encoders: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The encoder of a tokenizer file's content, kept by the worker process."""
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]
