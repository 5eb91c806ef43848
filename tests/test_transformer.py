"""Numpy transformers against sums written out one by one."""

import math

import numpy as np
import pytest

from glossator.functions import transformer as tr
from glossator.functions.encoders import embed
from glossator.functions.tokenizers import WordPiece

H, HEADS, FF, VOCAB = 16, 2, 24, 30


def network(layers, gated, seed=1):
    rng = np.random.default_rng(seed)
    r = lambda *shape: rng.normal(0, 0.5, shape)
    t = {"tt0": r(H), "pos": r(40, H), "emb_ln.g": r(H), "emb_ln.b": r(H)}
    whole = {"word": r(VOCAB, H)}
    for k in range(layers):
        whole |= {f"l{k}.qkv": r(3 * H, H), f"l{k}.o": r(H, H), f"l{k}.up": r(2 * FF if gated else FF, H), f"l{k}.down": r(H, FF)}
        t |= {f"l{k}.qkv.b": r(3 * H), f"l{k}.o.b": r(H), f"l{k}.down.b": r(H)} | ({} if gated else {f"l{k}.up.b": r(FF)})
        t |= {f"l{k}.{n}.{x}": r(H) for n in ("ln1", "ln2") for x in "gb"}
    for name, w in whole.items():
        q, s = tr.quantized_rows(w)
        t[f"{name}.q"], t[f"{name}.s"] = q.astype(np.int8), s.astype(np.float32)
    return {k: v if v.dtype == np.int8 else v.astype(np.float32) for k, v in t.items()}


def plain(t, ids, layers, gated, rotary, pooling, dim):
    """The network in loops over tokens, heads and numbers."""
    f = lambda name: np.asarray(t[name], float)

    def linear(x, name):
        out = []
        for row in x:
            s = max(abs(v) for v in row) / 127 or 1e-12
            q = [round(v / s) for v in row]
            out.append([sum(a * int(b) for a, b in zip(q, w)) * s * float(ws) for w, ws in zip(t[f"{name}.q"], t[f"{name}.s"])])
        return np.array(out) + (f(f"{name}.b") if f"{name}.b" in t else 0)

    def norm(x, name):
        return np.array([(row - row.mean()) / math.sqrt(((row - row.mean()) ** 2).mean() + 1e-12) * f(f"{name}.g") + f(f"{name}.b") for row in x])

    gelu = lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2)))
    x = np.array([t["word.q"][k] * float(t["word.s"][k]) for k in ids]) + f("tt0") + (0 if rotary else f("pos")[: len(ids)])
    x = norm(x, "emb_ln")
    hd = H // HEADS
    for k in range(layers):
        qkv, ctx = linear(x, f"l{k}.qkv"), np.zeros_like(x)
        for h in range(HEADS):
            q, key, v = (qkv[:, n * H + h * hd : n * H + (h + 1) * hd].copy() for n in range(3))
            if rotary:
                for m in (q, key):
                    for i in range(len(ids)):
                        for j in range(hd // 2):
                            a, b, w = m[i, j], m[i, j + hd // 2], i / 10000 ** (2 * j / hd)
                            m[i, j], m[i, j + hd // 2] = a * math.cos(w) - b * math.sin(w), b * math.cos(w) + a * math.sin(w)
            for i in range(len(ids)):
                e = [math.exp(sum(q[i] * key[j]) / math.sqrt(hd)) for j in range(len(ids))]
                ctx[i, h * hd : (h + 1) * hd] = sum(w / sum(e) * v[j] for j, w in enumerate(e))
        x = norm(x + linear(ctx, f"l{k}.o"), f"l{k}.ln1")
        up = linear(x, f"l{k}.up")
        up = np.array([[gelu(r[FF + i]) * r[i] for i in range(FF)] for r in up]) if gated else np.array([[gelu(v) for v in r] for r in up])
        x = norm(x + linear(up, f"l{k}.down"), f"l{k}.ln2")
    v = (x.mean(0) if pooling == "mean" else x[0])[:dim]
    return v / math.sqrt(sum(v * v))


@pytest.mark.parametrize(("gated", "rotary", "pooling", "dim"), [(False, False, "mean", H), (True, True, "cls", 8)])
def test_network(tmp_path, gated, rotary, pooling, dim):
    t = network(2, gated)
    config = {"flags": (tr.GATED if gated else 0) | (tr.ROTARY if rotary else tr.ABSOLUTE), "hidden": H, "heads": HEADS, "layers": 2, "max_tokens": 12, "pooling": tr.POOLINGS.index(pooling), "out_dim": dim, "ln_eps": 1e-12, "rope_theta": 10000 if rotary else 0}
    path = str(tmp_path / "w")
    tr.write_weights(path, {"config": config}, t)
    enc = tr.Transformer.load(path, lambda text: [ord(c) % VOCAB for c in text])
    got = enc.encode(["hello", "a", "", "longer than the limit is"])
    for text, v in zip(["hello", "a", None, "longer than "], got):
        want = np.zeros(dim) if text is None else plain(t, [ord(c) % VOCAB for c in text], 2, gated, rotary, pooling, dim)
        assert v == pytest.approx(want, abs=2e-4)
    with pytest.raises(ValueError):
        tr.read_weights(path, "0" * 64)


def test_kernels_and_dense_pooling():
    rng = np.random.default_rng(3)
    r = lambda *s: rng.normal(0, 0.4, s)
    named = {"embeddings|word_embeddings": r(VOCAB, H), "embeddings|token_type_embeddings": r(2, H), "embeddings|position_embeddings": r(20, H), "embeddings|LayerNorm|gamma": r(H), "embeddings|LayerNorm|beta": r(H), "pooler|dense|kernel": r(H, H), "pooler|dense|bias": r(H)}
    for n, a, b in (("attention|self|query", H, H), ("attention|self|key", H, H), ("attention|self|value", H, H), ("attention|output|dense", H, H), ("intermediate|dense", H, FF), ("output|dense", FF, H)):
        named |= {f"encoder|layer_0|{n}|kernel": r(a, b), f"encoder|layer_0|{n}|bias": r(b)}
    for n in ("attention|output|LayerNorm", "output|LayerNorm"):
        named |= {f"encoder|layer_0|{n}|gamma": r(H), f"encoder|layer_0|{n}|beta": r(H)}
    enc = tr.Transformer(tr.Shape(1, HEADS, H, "dense", activation="tanh"), tr.from_kernels(named, 1), lambda text: [ord(c) % VOCAB for c in text])
    x = enc.hidden([1, 2, 3])
    v = x[0] @ named["pooler|dense|kernel"] + named["pooler|dense|bias"]
    v = 0.5 * v * (1 + np.tanh(0.7978846 * (v + 0.044715 * v**3)))
    assert enc.encode([chr(VOCAB * 3 + 1) + chr(VOCAB * 3 + 2) + chr(VOCAB * 3 + 3)])[0] == pytest.approx(v / np.linalg.norm(v), abs=1e-6)
    full = x @ named["encoder|layer_0|intermediate|dense|kernel"] + named["encoder|layer_0|intermediate|dense|bias"]
    assert enc._linear(x, "l0.up") == pytest.approx(full)


def test_functions():
    x = np.linspace(-4, 4, 801)
    assert np.abs(tr.erf(x) - [math.erf(v) for v in x]).max() < 2e-7
    assert tr.round_half_even(np.array([0.5, 1.5, 2.5, -0.5])).tolist() == [0, 2, 2, 0]
    w = tr.WordVectors(np.arange(12, dtype=np.int8).reshape(6, 2), np.ones(6), most=2)
    assert w.rows([0, 1, 2, 0]).tolist() == [[0, 1], [2, 3], [4, 5], [0, 1]] and list(w.held) == [2, 0]


def test_in_a_frame(spark):
    words = WordPiece({w: i for i, w in enumerate("[UNK] [CLS] [SEP] one two three".split())})
    enc = tr.Transformer(tr.Shape(1, HEADS, H), network(1, False), words.encode)
    df = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    got = [r.embedding for r in embed(df, "t", enc).collect()]
    assert got[0] == pytest.approx(enc.encode(["one two three"])[0].tolist()) and got[1] == got[2] == pytest.approx(enc.encode([""])[0].tolist())
