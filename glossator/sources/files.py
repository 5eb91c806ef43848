"""Files in and out: documents as bytes, pages, the binary cache of an index, weight headers."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import hyphens_restored, pages_of

MAGIC, VERSION = b"SSVI", 1


def read_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, mtime, size, content) of files, read where they are."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def plain_extractor(content: bytes) -> str:
    """UTF-8 text, with form feeds between pages."""
    return content.decode("utf-8")


def extracted(files: DataFrame, extractor: Callable[[bytes], str] = plain_extractor) -> DataFrame:
    """(path, pages, error): an extractor's text by pages. A file that fails gives its error, not the job's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for content in b.content:
                try:
                    texts.append(extractor(bytes(content)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of a foreign extractor is this file's outcome
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"path": b.path, "text": texts, "error": errors})

    raw = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return raw.select("path", pages_of(hyphens_restored(F.col("text"))).alias("pages"), "error")


def html_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """df with pages: a web page's text without markup, as one page."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return df.withColumn("pages", F.array(t))


def pack_index(path: str, ids: list[tuple[str, str]], rowids, documents, sections, scales, vectors) -> bytes:
    """An index as one file: header with the database's path and document names, then aligned columns."""
    head = json.dumps({"dbPath": path, "docs": [list(x) for x in ids]}).encode()
    body = MAGIC + struct.pack("<III", VERSION, len(rowids), len(head)) + head
    body += bytes(-len(body) % 4)
    columns = (np.asarray(rowids, "<i4"), np.asarray(documents, "<i4"), np.asarray(sections, "<i4"), np.asarray(scales, "<f4"), np.asarray(vectors, np.int8))
    return body + b"".join(c.tobytes() for c in columns)


def unpack_index(data: bytes, path: str, dim: int) -> dict | None:
    """The columns of pack_index; None for another format, version, database or length."""
    if len(data) < 16 or data[:4] != MAGIC:
        return None
    version, n, size = struct.unpack_from("<III", data, 4)
    at = 16 + size + (-(16 + size) % 4)
    if version != VERSION or len(data) != at + n * (16 + dim):
        return None
    head = json.loads(data[16 : 16 + size])
    if head.get("dbPath") != path:
        return None
    out = {"docs": [tuple(x) for x in head["docs"]]}
    for name, kind in (("rowids", "<i4"), ("documents", "<i4"), ("sections", "<i4"), ("scales", "<f4")):
        out[name] = np.frombuffer(data, kind, n, at)
        at += 4 * n
    return out | {"vectors": np.frombuffer(data, np.int8, n * dim, at).reshape(n, dim)}


def read_index(files: DataFrame, path: str, dim: int) -> DataFrame:
    """(rowid, id, section_number, scale, q) of index files that belong to a database; others give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                x = unpack_index(bytes(content), path, dim)
                if x is not None:
                    live = x["documents"] >= 0  # others are tombstones
                    ids = [x["docs"][d][0] for d in x["documents"][live]]
                    yield pd.DataFrame({"rowid": x["rowids"][live].astype("int64"), "id": ids, "section_number": x["sections"][live], "scale": x["scales"][live], "q": [v.tobytes() for v in x["vectors"][live]]})

    return files.select("content").mapInPandas(run, "rowid long, id string, section_number int, scale float, q binary")


def appended(data: bytes | None, new: bytes, path: str, dim: int) -> bytes | None:
    """Two index files in one, documents numbered anew; None without a file of this database to append to."""
    old, more = (unpack_index(d, path, dim) if d else None for d in (data, new))
    if old is None or more is None:
        return None
    docs = list(dict.fromkeys([*old["docs"], *more["docs"]]))
    place = {d: i for i, d in enumerate(docs)}
    moved = np.array([place[d] for d in more["docs"]] or [0])
    both = {k: np.concatenate([old[k], more[k]]) for k in ("rowids", "sections", "scales", "vectors")}
    number = np.concatenate([old["documents"], np.where(more["documents"] >= 0, moved[np.maximum(more["documents"], 0)], -1)])
    return pack_index(path, docs, both["rowids"], number, both["sections"], both["scales"], both["vectors"])


def tensor_header(data: bytes) -> dict:
    """The JSON header of a tensor file: its length in eight bytes, up to 10 MiB, then itself."""
    (n,) = struct.unpack_from("<Q", data)
    if not 1 <= n <= 10 << 20 or len(data) < 8 + n:
        raise ValueError("not a tensor file")
    return json.loads(data[8 : 8 + n])


def preferences(text: str) -> dict:
    """name -> value of lines user_pref("name", value);"""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("user_pref(") and line.endswith(");"):
            try:
                name, value = json.loads(f"[{line[10:-2]}]")
            except ValueError:
                continue
            out[name] = value
    return out


def checked(path: str, sha256: str, size: int | None = None) -> str:
    """path, if the file has that hash (and size); its bytes pass by in pieces."""
    h, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
            n += len(part)
    if size is not None and n != size:
        raise ValueError(f"{path} has {n} bytes, not {size}")
    if h.hexdigest() != sha256.lower():
        raise ValueError(f"{path} has another hash")
    return path


def within(extract: Callable[[bytes], str], seconds: float = 300.0) -> Callable[[bytes], str]:
    """An extractor that runs in a process of its own and is killed when its time is up."""

    def run(content: bytes) -> str:
        from multiprocessing import get_context

        ours, theirs = get_context("fork").Pipe(duplex=False)
        p = get_context("fork").Process(target=_answer, args=(extract, content, theirs), daemon=True)
        p.start()
        theirs.close()
        try:
            if not ours.poll(seconds):
                raise TimeoutError(f"timeout: no text within {seconds:g} s")
            fine, value = ours.recv()
        except EOFError:
            raise ChildProcessError("crash: the extractor died") from None
        finally:
            p.kill()
            p.join()
            ours.close()
        if not fine:
            raise RuntimeError(value)
        return value

    return run


def _answer(extract: Callable[[bytes], str], content: bytes, to) -> None:
    try:
        to.send((True, extract(content)))
    except BaseException as e:  # noqa: BLE001 - told to the parent, whatever it is
        to.send((False, f"{type(e).__name__}: {e}"))
