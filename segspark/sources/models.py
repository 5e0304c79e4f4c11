"""Embedding models: a registry of named loaders, used once per Python worker."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from functools import cache
from importlib import import_module
from typing import Any
from urllib.parse import parse_qsl, urlencode

import numpy as np

#: name -> loader(path) -> function of a batch ``(n, frames, dims)`` to ``(n, embedding)``
REGISTRY: dict[str, Callable[[str], Callable[[np.ndarray], np.ndarray]]] = {}


def register(name: str):
    def add(loader):
        REGISTRY[name] = loader
        return loader

    return add


@register("pooling")
def pooling(path: str = ""):
    """A stand-in without weights: mean and standard deviation over time, projected by fixed cosines."""

    def embed(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        mean = x.mean(1)
        pooled = np.concatenate((mean, np.sqrt((x * x).mean(1) - mean**2 + 1e-10)), 1)
        size = int(path or 16)
        return pooled @ projection(pooled.shape[1], size)

    return embed


def projection(rows: int, cols: int) -> np.ndarray:
    """Rows of a discrete cosine basis."""
    return np.cos(np.pi * (np.arange(rows)[:, None] + 0.5) * np.arange(cols)[None] / rows) / np.sqrt(rows)


@register("onnx")
def onnx(path: str):
    """A model file for ``onnxruntime``; input ``(1, dims, frames)``, first input and output by place."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(path, options)
    source, target = session.get_inputs()[0].name, session.get_outputs()[0].name

    def embed(x: np.ndarray) -> np.ndarray:
        return np.stack([session.run([target], {source: m.astype(np.float32).T[None]})[0].squeeze() for m in x])

    return embed


def _torch_embed(t, model):
    model.eval()

    def embed(x: np.ndarray) -> np.ndarray:
        with t.no_grad():
            return model(t.from_numpy(np.asarray(x, np.float32)).transpose(1, 2)).numpy()

    return embed


@register("torch")
def torch(path: str):
    """A whole saved module; only where torch is installed."""
    import torch as t

    return _torch_embed(t, t.load(path, map_location="cpu", weights_only=False))


def state_path(weights: str, network: str, feat_dim: int = 64, embed_dim: int = 256) -> str:
    """The path of ``torch_state`` for a network ``package.module:Class`` and a file of its weights."""
    return f"{weights}?{urlencode({'network': network, 'feat_dim': feat_dim, 'embed_dim': embed_dim})}"


@register("torch_state")
def torch_state(path: str):
    """A network class, imported by name, with weights from a checkpoint's ``state_dict``; see ``state_path``.

    Weights that the network does not have, or that the checkpoint lacks, are passed over.
    """
    import torch as t

    weights, _, options = path.partition("?")
    options = dict(parse_qsl(options))
    module, _, name = options["network"].partition(":")
    network = getattr(import_module(module), name)(feat_dim=int(options["feat_dim"]), embed_dim=int(options["embed_dim"]))
    network.load_state_dict(t.load(weights, map_location="cpu")["state_dict"], strict=False)
    return _torch_embed(t, network)


@cache
def load(name: str, path: str = "") -> Callable[[np.ndarray], np.ndarray]:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](path)


def assemble(parts: dict[str, bytes]) -> dict[str, bytes]:
    """Files of a zip archive that came in parts, joined in order of their names."""
    whole = b"".join(parts[k] for k in sorted(parts))
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        return {n: z.read(n) for n in z.namelist()}


#: Fixed value: how an HDF5 file begins.
HDF5 = b"\x89HDF\r\n\x1a\n"


def read_transform(path: str) -> dict[str, Any]:
    """Centring and projection ``mean1, lda, mean2`` from JSON, or from HDF5 where ``h5py`` is installed."""
    with open(path, "rb") as fd:
        raw = fd.read()
    if raw.startswith(HDF5):
        try:
            import h5py
        except ModuleNotFoundError as gone:
            raise ValueError(f"{path} is HDF5: install h5py, or write its datasets mean1, lda and mean2 as JSON lists") from gone
        with h5py.File(path, "r") as f:
            got = {k: np.asarray(f[k], float).tolist() for k in f if k in ("mean1", "lda", "mean2")}
    else:
        got = json.loads(raw)
    missing = {"mean1", "lda", "mean2"} - got.keys()
    if missing:
        raise ValueError(f"transform lacks {sorted(missing)}")
    return got
