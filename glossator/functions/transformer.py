"""Transformer encoders in numpy: absolute or rotary positions, plain or gated layers, three ways to pool, full or 8-bit products.

A weight file holds a JSON header, padded to 64 bytes, and the tensors it lists by type, shape, offset and length. Matrices are
whole numbers of 8 bits with a scale for each row; activations are quantised by token before every product. Word vectors are
read from the mapped file as they are needed, so a task holds those of its own texts.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..sources.files import checked

MAGIC, VERSION, ALIGN = b"SSEW", 1, 64
GATED, ROTARY, ABSOLUTE = 1, 2, 4
#: Pooling by its number in a header.
POOLINGS = ("mean", "cls", "dense")
#: Word vectors that an encoder remembers.
ROWS = 30_000


def round_half_even(x: np.ndarray) -> np.ndarray:
    return np.rint(x)


def quantized_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as whole numbers of -127 to 127, and the scale of each."""
    scale = np.abs(x).max(1) / 127
    scale = np.where(scale == 0, 1e-12, scale)
    return np.clip(round_half_even(x / scale[:, None]), -127, 127), scale


def linear8(x: np.ndarray, weight: tuple[np.ndarray, np.ndarray], bias: np.ndarray | None = None) -> np.ndarray:
    """x @ w.T + bias from 8-bit rows of both; sums of whole numbers are exact in double precision."""
    q, s = quantized_rows(x)
    out = (q @ weight[0].astype(np.float64).T) * s[:, None] * weight[1][None]
    return out if bias is None else out + bias


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by a rational approximation of an error below 1.2e-7."""
    t = 1 / (1 + 0.5 * np.abs(x))
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    y = 1 - t * np.exp(-x * x + np.polyval(c[::-1], t))
    return np.where(x >= 0, y, -y)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2)))


def gelu_tanh(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978846 * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * gain + shift


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def rotated(x: np.ndarray, base: float) -> np.ndarray:
    """(heads, tokens, width) turned by place: the first half of a head's width pairs with the second."""
    half = x.shape[-1] // 2
    angle = np.arange(x.shape[1])[:, None] / base ** (np.arange(half) * 2 / x.shape[-1])[None]
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], -1)


def write_weights(path: str, header: dict, tensors: dict[str, np.ndarray]) -> None:
    """A weight file of 8-bit and 32-bit float tensors, each at a multiple of ALIGN."""
    body, index = bytearray(), {}
    for name, x in tensors.items():
        x = np.ascontiguousarray(x if x.dtype == np.int8 else x.astype("<f4"))
        body += bytes(-len(body) % ALIGN)
        index[name] = {"dtype": "i8" if x.dtype == np.int8 else "f32", "shape": list(x.shape), "offset": len(body), "length": x.nbytes}
        body += x.tobytes()
    text = json.dumps(header | {"tensors": index}, separators=(",", ":")).encode()
    head = MAGIC + struct.pack("<II", VERSION, len(text)) + text
    with open(path, "wb") as f:
        f.write(head + bytes(-len(head) % ALIGN) + body)


def read_weights(path: str, sha256: str | None = None) -> tuple[dict, dict[str, np.ndarray]]:
    """The header, and the tensors as views of the mapped file."""
    if sha256:
        checked(path, sha256)
    data = np.memmap(path, np.uint8, "r")
    version, size = struct.unpack("<II", data[4:12].tobytes())
    if data[:4].tobytes() != MAGIC or version != VERSION:
        raise ValueError("not a weight file of version 1")
    header = json.loads(data[12 : 12 + size].tobytes())
    start = -(-(12 + size) // ALIGN) * ALIGN
    out = {}
    for name, t in header["tensors"].items():
        at = start + t["offset"]
        if at + t["length"] > len(data):
            raise ValueError(f"{name} is cut short")
        out[name] = data[at : at + t["length"]].view("i1" if t["dtype"] == "i8" else "<f4").reshape(t["shape"])
    return header, out


@dataclass(frozen=True)
class Shape:
    """What the numbers of a network don't say. pooling: cls, mean, or dense (a layer over the first token)."""

    layers: int
    heads: int
    dim: int
    pooling: str = "mean"
    flags: int = ABSOLUTE
    rope_base: float = 10_000.0
    eps: float = 1e-12
    activation: str = "erf"
    most: int = 512


class WordVectors:
    """Rows of the word table in floats; the last ROWS used are remembered."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, most: int = ROWS):
        self.q, self.scale, self.most = q, scale, most
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def rows(self, ids: list[int]) -> np.ndarray:
        out = []
        for k in ids:
            row = self.held.pop(k, None)
            if row is None:
                row = self.q[k].astype(np.float64) * float(self.scale[k])
            self.held[k] = row
            if len(self.held) > self.most:
                self.held.popitem(last=False)
            out.append(row)
        return np.array(out)


class Transformer:
    """An encoder of texts: ``tokenize`` gives ids with their borders, the tensors do the rest."""

    def __init__(self, shape: Shape, tensors: dict[str, np.ndarray], tokenize: Callable[[str], list[int]]):
        self.shape, self.tokenize, self.dim = shape, tokenize, shape.dim
        self.t = tensors
        self.words = WordVectors(tensors["word.q"], tensors["word.s"])
        self.act = gelu if shape.activation == "erf" else gelu_tanh

    @classmethod
    def load(cls, path: str, tokenize: Callable[[str], list[int]], sha256: str | None = None) -> "Transformer":
        header, tensors = read_weights(path, sha256)
        c = header["config"]
        shape = Shape(c["layers"], c["heads"], c["out_dim"], POOLINGS[c["pooling"]], c["flags"], float(c.get("rope_theta") or 10_000), float(c["ln_eps"]), most=c["max_tokens"])
        return cls(shape, tensors, tokenize)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        bias = self.t.get(f"{name}.b")
        if f"{name}.q" in self.t:
            return linear8(x, (self.t[f"{name}.q"], self.t[f"{name}.s"]), bias)
        out = x @ self.t[f"{name}.w"].astype(np.float64).T
        return out if bias is None else out + bias

    def hidden(self, ids: list[int]) -> np.ndarray:
        """The last layer's vectors, a row a token."""
        s, t = self.shape, self.t
        x = self.words.rows(ids) + t["tt0"]
        if s.flags & ABSOLUTE:
            x = x + t["pos"][: len(ids)]
        x = layer_norm(x, t["emb_ln.g"], t["emb_ln.b"], s.eps)
        n, h = x.shape
        for k in range(s.layers):
            qkv = self._linear(x, f"l{k}.qkv").reshape(n, 3, s.heads, h // s.heads).transpose(1, 2, 0, 3)
            q, key, v = qkv
            if s.flags & ROTARY:
                q, key = rotated(q, s.rope_base), rotated(key, s.rope_base)
            a = softmax(q @ key.transpose(0, 2, 1) / np.sqrt(h // s.heads))
            x = layer_norm(x + self._linear((a @ v).transpose(1, 0, 2).reshape(n, h), f"l{k}.o"), t[f"l{k}.ln1.g"], t[f"l{k}.ln1.b"], s.eps)
            up = self._linear(x, f"l{k}.up")
            if s.flags & GATED:
                up, gate = np.split(up, 2, axis=1)
                up = self.act(gate) * up
            else:
                up = self.act(up)
            x = layer_norm(x + self._linear(up, f"l{k}.down"), t[f"l{k}.ln2.g"], t[f"l{k}.ln2.b"], s.eps)
        return x

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            ids = self.tokenize(text)[: self.shape.most]
            if not ids:
                continue
            x = self.hidden(ids)
            v = x.mean(0) if self.shape.pooling == "mean" else x[0]
            if self.shape.pooling == "dense":
                v = gelu_tanh(self._linear(v[None], "pool")[0])
            v = v[: self.dim]
            row[:] = v / np.sqrt(max(float(v @ v), 1e-24))
        return out


def from_kernels(named: dict[str, np.ndarray], layers: int) -> dict[str, np.ndarray]:
    """Tensors of a network whose variables are called ``encoder|layer_0|output|dense|kernel`` and are kept input by output."""
    part = lambda p, n: (named[f"{p}{n}|kernel"].T, named[f"{p}{n}|bias"])
    q, scale = quantized_rows(named["embeddings|word_embeddings"])
    out = {"word.q": q.astype(np.int8), "word.s": scale, "tt0": named["embeddings|token_type_embeddings"][0], "pos": named["embeddings|position_embeddings"]}
    out |= {"emb_ln.g": named["embeddings|LayerNorm|gamma"], "emb_ln.b": named["embeddings|LayerNorm|beta"]}
    for k in range(layers):
        p = f"encoder|layer_{k}|"
        three = [part(p, f"attention|self|{n}") for n in ("query", "key", "value")]
        out[f"l{k}.qkv.w"], out[f"l{k}.qkv.b"] = (np.concatenate(x) for x in zip(*three, strict=True))
        for mine, theirs in (("o", "attention|output|dense"), ("up", "intermediate|dense"), ("down", "output|dense")):
            out[f"l{k}.{mine}.w"], out[f"l{k}.{mine}.b"] = part(p, theirs)
        for mine, theirs in (("ln1", "attention|output|LayerNorm"), ("ln2", "output|LayerNorm")):
            out[f"l{k}.{mine}.g"], out[f"l{k}.{mine}.b"] = named[f"{p}{theirs}|gamma"], named[f"{p}{theirs}|beta"]
    out["pool.w"], out["pool.b"] = part("", "pooler|dense")
    return out
