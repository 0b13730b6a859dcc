"""Identity: how ids and fingerprints come from content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _prefixed(prefix: str, key: Column, digits: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(text_hash(key), 1, digits))


def document_id(source_id: Column) -> Column:
    return _prefixed("doc-", source_id, 20)


def chunk_id(document: Column, chunk_key: Column) -> Column:
    return _prefixed("chk-", F.concat(document, F.lit("|"), chunk_key), 24)


def text_source_id(origin: Column, text: Column) -> Column:
    return _prefixed("src-", F.concat(origin, text), 20)


def file_source_id(path: Column) -> Column:
    return _prefixed("file-", path, 20)


def link_source_id(address: Column) -> Column:
    return _prefixed("desktop-", url_identity(address), 20)


def note_source_id(root: Column, relative: Column) -> Column:
    return _prefixed("obsidian-", F.concat(root, F.char(F.lit(0)), relative), 20)


def package_id(stem: Column) -> Column:
    return _prefixed("package-", stem, 20)


def relation_id(source: Column, target: Column, kind: str = "supports") -> Column:
    return _prefixed("rel-", F.concat_ws("|", source, target, F.lit(kind)), 24)


def proposal_fingerprint(*parts: Column) -> Column:
    """Nulls count as empty, so that a missing part keeps its place."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def canonical_json(fields: Column) -> Column:
    """A map as JSON with its keys in order, without white space: equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def content_hash(segments: Column) -> Column:
    """Of an array of structs (sequence, id, ...): ordered, without the ids, as canonical JSON."""
    ordered = F.array_sort(segments)
    return F.sha2(F.to_json(F.transform(ordered, lambda s: s.dropFields("id"))), 256)


def url_identity(address: Column) -> Column:
    """Scheme and host in lower case, without a fragment; other strings as they are."""
    scheme, host = F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(address, r"://([^/?#]*)", 1)
    rest = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host), rest)).otherwise(address)


#: Other names of recognisers, and the profiles that there are (fixed values).
PROVIDER_ALIASES = {
    "auto": None,
    "qwen": "qwen3-mlx",
    "qwen3": "qwen3-mlx",
    "qwen3-asr": "qwen3-mlx",
    "mlx": "mlx-whisper",
    "whisper-mlx": "mlx-whisper",
    "faster": "faster-whisper",
    "cpu": "faster-whisper",
    "cuda": "faster-whisper",
}


def _folded_name(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))


def provider_id(value: Column) -> Column:
    """The name of a recogniser; null where any will do."""
    name = _folded_name(F.coalesce(value, F.lit("")))
    out = F.when(name != "", name)
    for alias, provider in PROVIDER_ALIASES.items():
        out = F.when(name == alias, F.lit(provider)).otherwise(out)
    return out


def profile_id(value: Column, known: tuple[str, ...]) -> Column:
    """A known profile's name, else ``custom``."""
    name = _folded_name(F.coalesce(value, F.lit("custom")))
    return F.when(name.isin(*known), name).otherwise(F.lit("custom"))


#: Texts whose features are hashed at once.
HASHED = 256


def _hashed(rows: pa.ListArray, dimensions: int) -> np.ndarray:
    """Vectors of lists of features, one after another; null features have no part in them."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), sizes)
    coded = rows.flatten().dictionary_encode()
    values = np.array([int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") for f in coded.dictionary.to_pylist()], np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    at, sign = (values % np.uint64(dimensions)).astype(np.int64)[code], np.where(values >> np.uint64(63), 1.0, -1.0)[code]
    vectors = np.bincount(row * dimensions + at, sign, len(rows) * dimensions).reshape(len(rows), dimensions)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32).ravel()


def hashed_vector(features: Column, dimensions: int = 384) -> Column:
    """Signed feature hashing with BLAKE2b, normalised to length 1; no features give the null vector.

    No built-in computes BLAKE2b: tasks hash each distinct feature of a few texts once.
    """
    if dimensions < 32:
        raise ValueError("at least 32 dimensions")

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_hashed(batch.slice(at, HASHED), dimensions) for at in range(0, len(batch), HASHED)]
            yield pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.zeros(0, np.float32), *parts])), dimensions).cast(pa.list_(pa.float32()))

    return embed(features)
