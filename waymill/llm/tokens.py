"""Token counts of fields and sections: documents are encoded once, and tokens attributed by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file of byte-level BPE ranks (base64 token, rank) and the pattern that splits text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Section = tuple[str, int, int]


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, about a megabyte, read by the driver alone."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks_of: bytes):
    """The encoding of a vocabulary file and the bytes of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_of.splitlines())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, ranks_of: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of a whole text. Tokens join to the text's UTF-8, so that
    lengths give their places; a token with a part of a character spans that character."""
    encoding, sizes = encoder(ranks_of)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) != len(text):
        of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return of[start], of[end - 1] + 1
    return start, end


def lines(text: str) -> list[Section]:
    """Sections from each line's first character to its line feed, named by their number."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((str(len(out)), at, end))
        at = end
    return out


def bare_lines(text: str) -> list[Section]:
    """Sections of the lines that aren't blank, without their line feeds, named by their number."""
    return [(name, a, b - text.endswith("\n", a, b)) for name, a, b in lines(text) if text[a:b].strip()]


def attribute(start: np.ndarray, end: np.ndarray, sections: list[Section]) -> tuple[np.ndarray, int, int]:
    """(tokens of each section, tokens that cross a boundary, tokens outside all sections).

    The rule for a token over several sections: it belongs to the one with most of its characters,
    among equals to the first. A token without a character in any section belongs to none. Sections
    are joined as sorted intervals; what a section shares with an earlier one counts for the earlier.
    """
    counts = np.zeros(len(sections), np.int64)
    if not len(start) or not sections:
        return counts, 0, len(start)
    order = sorted(range(len(sections)), key=lambda i: (sections[i][1], i))
    lo = np.array([sections[i][1] for i in order])
    hi = np.array([sections[i][2] for i in order])
    lo = np.maximum(lo, np.append(0, np.maximum.accumulate(hi)[:-1]))
    hi = np.maximum(lo, hi)
    first = np.searchsorted(hi, start, side="right")
    last = np.searchsorted(lo, end, side="left") - 1
    simple = (first == last) & (start >= lo[np.minimum(first, len(lo) - 1)]) & (end <= hi[np.minimum(first, len(lo) - 1)])
    owner = np.where(simple, first, -1)
    crossing = 0
    for i in np.flatnonzero(~simple):
        j = np.arange(first[i], last[i] + 1)
        share = np.minimum(hi[j], end[i]) - np.maximum(lo[j], start[i])
        if len(share) and share.max() > 0:
            owner[i] = j[share.argmax()]
            crossing += 1
    got = np.bincount(owner[owner >= 0], minlength=len(order))
    counts[order] = got
    return counts, crossing, int((owner < 0).sum())


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), sections: Callable[[str], list[Section]] = lines, path: str = VOCABULARY, joint: str = "\n") -> DataFrame:
    """(doc_id, n_chars, n_tokens, field_tokens, n_sections, section_names, section_tokens, n_crossing, n_outside).

    The fields of a row, joined by ``joint``, are encoded once as one document. Its tokens are
    attributed to the fields, and those of the last field's span to its sections too: ``sections`` gives
    (name, start, end) in characters of the last field. ``n_crossing`` and ``n_outside`` count tokens
    that cross a section's boundary, and tokens of the document outside all sections. Null fields are
    empty, empty documents have no tokens; whole texts are encoded whatever their length; repeated rows
    are counted apart. An empty table gives no rows. Input columns may have any name. Tasks get the vocabulary
    from the driver, so that executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["doc_id", "n_chars", "n_tokens", "field_tokens", "n_sections", "section_names", "section_tokens", "n_crossing", "n_outside"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of = shared.value
        for batch in batches:
            out = []
            for doc, *texts in zip(batch.column(0).to_pylist(), *(batch.column(i + 1).to_pylist() for i in range(len(fields)))):
                texts = [t or "" for t in texts]
                begins, at = [], 0
                for t in texts:
                    begins.append(at)
                    at += len(t) + len(joint)
                whole = joint.join(texts)
                start, end = token_spans(whole, ranks_of)
                of_fields, _, _ = attribute(start, end, [(f, b, b + len(t)) for f, b, t in zip(fields, begins, texts)])
                found = [(n, a + begins[-1], b + begins[-1]) for n, a, b in sections(texts[-1])]
                of_sections, crossing, outside = attribute(start, end, found)
                out.append((doc, len(whole), len(start), of_fields.tolist(), len(found), [s[0] for s in found], of_sections.tolist(), crossing, outside))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, field_tokens array<long>, n_sections long, section_names array<string>, section_tokens array<long>, n_crossing long, n_outside long")
