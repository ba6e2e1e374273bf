"""Token ids of whole texts by a public tokenizer, each distinct chunk of a batch encoded once.

The tokenizer's pattern always starts a new pre-token at a space that stands before a character that is no white space,
and merges never cross pre-tokens. So a text may be cut before such spaces and each chunk encoded by itself; chunks
repeat, so a batch encodes each distinct chunk once. Texts that hold an added token's string are encoded whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = re.compile(r"(?= \S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_OWN: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: loaded once, as Spark reuses its Python workers."""
    path = path or default_path()
    if path not in _OWN:
        _OWN[path] = Encoder(path)
    return _OWN[path]


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _fast(path: str):
    """The same byte-level merges in tiktoken, built from the tokenizer's own file; None unless an id's order is its merge's order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return None
    vocab, of = model["vocab"], _byte_names()
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab[p] for p in pairs]
    if ids != sorted(ids) or len(vocab) != len(set(pairs)) + 256 or ids[0] < 256:
        return None
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(of[c] for c in token): k for token, k in vocab.items()}, special_tokens={})


class Encoder:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _fast(path)
        self.bytes = np.array([len(self.fast.decode_single_token_bytes(k)) for k in range(self.fast.n_vocab)]) if self.fast else None

    def ids(self, text: str) -> np.ndarray:
        """The ids by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def chunks(self, text: str) -> list[str]:
        """The text cut at places where its encoding has a boundary in any case."""
        if not text or any(t in text for t in self.added):
            return [text] if text else []
        return [c for c in CHUNK.split(text) if c]

    def spaced(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each name, one after the other, and how many each has. No name is empty or starts with white space."""
        out, counts = [], []
        sizes = pc.binary_length(names).to_numpy() + 1
        for k in range(0, len(names), 20_000):
            part = names.slice(k, 20_000)
            text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.cast(pa.string())), " ")[0].as_py()
            # Libraries may know other versions of Unicode; up to Latin Extended-B they agree.
            if self.fast is None or max(text) >= "\u0250":
                each = [self.ids(" " + c) for c in part.to_pylist()]
                out += each
                counts.append(np.array([len(x) for x in each], np.int64))
                continue
            ids = np.array(self.fast.encode_ordinary(text), "<u4")
            ends, after = np.cumsum(sizes[k : k + 20_000]), np.concatenate([[0], np.cumsum(self.bytes[ids])])
            at = np.searchsorted(after, ends)
            if not (after[at] == ends).all():
                raise AssertionError("a token crosses a chunk")
            out.append(ids)
            counts.append(np.diff(at, prepend=0))
        return (np.concatenate(out) if out else np.zeros(0, "<u4")), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def coded(self, all_texts: pa.Array) -> dict[str, np.ndarray]:
        """Texts as chunks, each distinct chunk encoded once: index (chunk numbers, text after text), offsets of the texts in it, and each chunk's tokens, characters and start in ids."""
        all_texts = all_texts.cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(all_texts, r"^ | $| \s"))
        for t in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(all_texts, t)))
        plain = pc.and_(plain, pc.not_equal(all_texts, ""))
        split = pc.split_pattern(pc.if_else(plain, all_texts, ""), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        names = coded.dictionary
        index = coded.indices.to_numpy().astype(np.int64)
        # The first chunk of a text has no space before it; texts of other shapes are encoded whole in its place.
        firsts = [names[i].as_py() if ok else t.as_py() for i, ok, t in zip(index[offsets[:-1]], plain.to_numpy(zero_copy_only=False), all_texts, strict=True)]
        heads = [self.ids(t) for t in firsts]
        ids, lens = self.spaced(pc.if_else(pc.equal(names, ""), "x", names))  # an empty name stands for other texts only
        index[offsets[:-1]] = len(names) + np.arange(len(heads))
        start = np.concatenate([np.cumsum(lens) - lens, len(ids) + np.cumsum([0, *map(len, heads)])[:-1]]).astype(np.int64)
        chars = np.concatenate([pc.utf8_length(names).to_numpy() + 1, np.fromiter(map(len, firsts), np.int64, len(firsts))])
        return {"index": index, "offsets": offsets, "tokens": np.concatenate([lens, np.fromiter(map(len, heads), np.int64, len(heads))]), "chars": chars, "start": start, "ids": np.concatenate([ids, *heads])}

    def batch(self, all_texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has."""
        c = self.coded(all_texts)
        n = c["tokens"][c["index"]]
        to = np.cumsum(n)
        out = c["ids"][np.repeat(c["start"][c["index"]] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
        total = np.concatenate([[0], to])
        return out, total[c["offsets"][1:]] - total[c["offsets"][:-1]]
