"""Token ids of texts, by a tokenizer file that a parameter names."""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_ID = 2
#: Characters of a text that are encoded at once, and the white space in a row that the rank-based library may see.
SEGMENT, LONGEST_SPACE = 1 << 16, 10_000
_SPLIT = re.compile("(?<=[0-9A-Za-z]) ")
_LONG_SPACE = re.compile(rf"\s{{{LONGEST_SPACE}}}")
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(spec: dict, model) -> dict[bytes, int] | None:
    """Ranks by bytes of a byte-level BPE file; None where merging by rank could give other ids than the file's merges.

    Merging by rank gives the ids of merging by rule if the ids follow the merges and each token, taken as a text of
    its own, is encoded as itself: then no merge by rank joins what no rule joins.
    """
    bpe, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = bpe.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(bpe.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ids = [bpe["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in bpe["merges"])]
    words = {t: i for t, i in bpe["vocab"].items() if t not in special}
    if ids != sorted(ids) or not byte_of.keys() <= words.keys():
        return None
    if any([t.id for t in model.tokenize(word)] != [i] for word, i in words.items()):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in words.items()}


class Encoder:
    """Encodes whole texts as the file's own library does; the ids come as little-endian integers of `width` bytes.

    Texts are cut where a space follows an ASCII letter or digit: there a byte-level pre-tokenizer always ends a
    piece. A byte-level BPE file is also read into the rank-based library, which gives the same ids in a sixth of the
    time. Parts that hold an added token or a very long run of white space, and other kinds of files, go to the
    file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        self.ranked = None
        apart = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
        if apart and (ranks := _ranks(spec, self.tokenizer.model)):
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str):
        at = 0
        while len(text) - at > SEGMENT and (cut := _SPLIT.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _ids(self, text: str) -> list[int]:
        if any(t in text for t in self.added) or _LONG_SPACE.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        if self.ranked is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return b"".join(np.array(self._ids(part), dtype=self.dtype).tobytes() for part in self._parts(text))


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; the default is the public 50k byte-level vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def as_u32(ids: bytes, width: int) -> bytes:
    """The ids as unsigned little-endian 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
