"""Static embeddings: a table of token vectors, averaged with weights; the tensors are read once per worker."""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TYPES = {"F32": np.float32, "F64": np.float64, "I64": np.int64}
MAX_TOKENS, CHARS_PER_TOKEN = 512, 7


def is_static_model(name: str) -> bool:
    """Whether a model's name says that it is a table of token vectors; others are networks, which are not run here."""
    return name.startswith("minishlab/") or any(part.startswith(("potion", "model2vec")) for part in name.lower().split("/"))


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors of a file: eight bytes of header length, a JSON header, the data. Other number types raise."""
    raw = Path(path).read_bytes()
    (size,) = struct.unpack_from("<Q", raw)
    header, data = json.loads(raw[8 : 8 + size]), memoryview(raw)[8 + size :]
    tensors = {}
    for name, info in header.items():
        if name == "__metadata__":
            continue
        if info["dtype"] not in _TYPES:
            raise ValueError(f"{name} has numbers of type {info['dtype']}")
        a, b = info["data_offsets"]
        tensors[name] = np.frombuffer(data[a:b], dtype=_TYPES[info["dtype"]]).reshape(info["shape"])
    return tensors


@lru_cache(maxsize=2)
def _model(tensors: str, tokenizer: str):
    from tokenizers import Tokenizer

    t = read_safetensors(tensors)
    rows = t["embeddings"].astype(np.float64)
    return Tokenizer.from_file(tokenizer), rows, t.get("mapping", np.arange(len(rows))), t.get("weights", np.ones(len(rows)))


def static_embed(tensors: str, tokenizer: str, unknown: int = 1):
    """Column function: text -> array<float>, the mean of weighted token vectors, of unit length.

    Paths are read by each worker once (a shared folder on a cluster). Texts are cut to
    MAX_TOKENS tokens as the model's own encoder does; a text without known tokens gives zeros.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        encoder, rows, mapping, weights = _model(tensors, tokenizer)

        def one(text: str | None) -> np.ndarray:
            ids = [i for i in encoder.encode((text or "")[: MAX_TOKENS * CHARS_PER_TOKEN], add_special_tokens=False).ids if i != unknown][:MAX_TOKENS]
            if not ids:
                return np.zeros(rows.shape[1], dtype=np.float32)
            v = (rows[mapping[ids]] * weights[ids][:, None]).sum(axis=0) / len(ids)
            return (v / (np.linalg.norm(v) + 1e-32)).astype(np.float32)

        return texts.map(one)

    return embed
