"""Embedding, indexing and retrieval over a collection.

Embedders are plug-ins ``call(texts) -> vectors`` that run in the tasks on Arrow batches; stores are versioned tables;
retrievers take a table of queries and give one flat table of results.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siftwell.operators import search
from siftwell.sources import files
from siftwell.sources.store import Collection

Call = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class ConfigError(ValueError):
    pass


class EmbeddingError(ValueError):
    pass


class StoreError(RuntimeError):
    pass


class RequestError(ValueError):
    """A request that is refused, with the status to answer."""

    status = 400


def positive(value: object, name: str) -> int:
    if type(value) is int and value > 0:
        return value
    raise ConfigError(f"{name}: a whole number above 0 is needed, not {value!r}")


class Store(Protocol):
    """What indexers and retrievers need of a store; ``Collection`` is one."""

    spark: SparkSession

    def scan(self, filters: dict | None = None, vectors: bool = False) -> DataFrame | None: ...

    def write(self, docs: DataFrame, key: str = "id", order: str | None = None, policy: str = "OVERWRITE") -> None: ...

    def count(self, filters: dict | None = None) -> int: ...

    def clear(self) -> None: ...


@dataclass(frozen=True)
class Profile:
    """How texts reach an encoder. ``max_length`` is for encoders that cut their input."""

    query_prefix: str = ""
    document_prefix: str = ""
    max_length: int = 512
    batch_size: int = 64
    skip_prefix_if_present: bool = True

    def __post_init__(self) -> None:
        positive(self.max_length, "max_length")
        positive(self.batch_size, "batch_size")

    def prefixed(self, text: Column, prefix: str) -> Column:
        if not prefix:
            return text
        return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text)) if self.skip_prefix_if_present else F.concat(F.lit(prefix), text)


def _embedded(batches: Iterator[pa.RecordBatch], call: Call, size: int) -> Iterator[pa.RecordBatch]:
    """Append vectors to batches whose last column is the text, which goes."""
    for b in batches:
        texts, vectors = b.column(b.num_columns - 1).to_pylist(), []
        for i in range(0, len(texts), size):
            some = texts[i : i + size]
            got = np.asarray(call(some), float) if some else np.zeros((0, 1))
            if got.ndim != 2 or len(got) != len(some) or not got.shape[1] or not np.isfinite(got).all():
                raise EmbeddingError(f"{len(some)} texts need as many finite vectors of one length")
            vectors += got.tolist()
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "vector"])


@dataclass(frozen=True)
class Embedder:
    """Vectors of texts; null texts count as empty."""

    call: Call
    profile: Profile = field(default_factory=Profile)

    def _embed(self, df: DataFrame, text: str, out: str, prefix: str) -> DataFrame:
        t = self.profile.prefixed(F.coalesce(F.col(text), F.lit("")), prefix)
        rest = df.drop(out)
        schema = rest.schema.add("vector", ArrayType(DoubleType()))
        return rest.withColumn("vector", t).mapInArrow(partial(_embedded, call=self.call, size=self.profile.batch_size), schema).withColumnRenamed("vector", out)

    def documents(self, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        return self._embed(df, text, out, self.profile.document_prefix)

    def queries(self, df: DataFrame, text: str = "query", out: str = "vector") -> DataFrame:
        return self._embed(df, text, out, self.profile.query_prefix)


def ordered_vectors(response: Any, n: int) -> list[list[float]]:
    """Vectors of a response ``{"data": [{"index", "embedding"}, ...]}`` in the order asked for; each must stand there once."""
    data = response.get("data") if isinstance(response, Mapping) else None
    if not isinstance(data, list):
        raise EmbeddingError("no list of data in the response")
    slots: list = [None] * n
    for d in data:
        i, v = (d.get("index"), d.get("embedding")) if isinstance(d, Mapping) else (None, None)
        if type(i) is not int or not 0 <= i < n or slots[i] is not None or not isinstance(v, (list, tuple)):
            raise EmbeddingError(f"unusable entry for index {i!r}")
        slots[i] = list(v)
    if None in slots:
        raise EmbeddingError(f"no vector for index {slots.index(None)}")
    return slots


def http_post(url: str, key: str | None, timeout: float, payload: dict) -> Any:
    """POST JSON with the standard library; failures don't show the key."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), headers), timeout=timeout) as r:
            return json.load(r)
    except (OSError, ValueError) as e:
        raise EmbeddingError(f"request to {url} failed: {type(e).__name__}") from e


def remote_call(model: str, post: Callable[[dict], Any], encoding_format: str | None = None, extra: Mapping[str, Any] | None = None) -> Call:
    """A plug-in that asks a service; ``post`` sends one payload and returns the parsed answer."""

    def call(texts: Sequence[str]) -> list[list[float]]:
        payload = {**(extra or {}), "model": model, "input": list(texts)}
        if encoding_format is not None:
            payload["encoding_format"] = encoding_format
        return ordered_vectors(post(payload), len(texts))

    return call


@dataclass(frozen=True)
class Indexer:
    store: Store
    embedder: Embedder | None = None

    def index(self, docs: DataFrame, policy: str = "OVERWRITE", order: str | None = None) -> int:
        """Write documents ``(id, content, ...)`` and return how many rows came in.

        Without an embedder vectors are cleared. The plug-in is asked once per row: what it gave is written aside and
        checked before the store's own joins read it; nothing is published if that fails.
        """
        spark = docs.sparkSession
        made = self.embedder.documents(docs) if self.embedder else docs.withColumn("embedding", F.lit(None).cast("array<double>"))
        aside = f"{files.shared_dir(spark)}/index-{uuid.uuid4().hex}"
        try:
            made.write.parquet(aside)
            rows = spark.read.schema(made.schema).parquet(aside)
            if self.embedder:
                search.check_vectors(rows, "embedding")
            try:
                self.store.write(rows, order=order, policy=policy)
            except Exception as e:
                raise StoreError("the documents could not be written") from e
            return rows.count()
        finally:
            files.delete(spark, aside)


MODES = ("keyword", "vector", "hybrid")


class Retriever:
    """Search a store by keywords, vectors or both."""

    def __init__(self, store: Store, mode: str = "keyword", embedder: Embedder | None = None, alpha: float = 0.5):
        if mode not in MODES:
            raise ConfigError(f"unknown mode {mode!r}")
        if mode != "keyword" and embedder is None:
            raise ConfigError(f"mode {mode} needs an embedder")
        self.store, self.mode, self.embedder, self.alpha = store, mode, embedder, search.check_alpha(alpha)

    def retrieve_many(self, queries: DataFrame, top_k: int = 5, filters: dict | None = None, vectors: bool = False, alpha: float | None = None) -> DataFrame:
        """``query_id, rank, score`` and the documents' columns for ``queries(query_id, query)``; no queries or no documents give no rows."""
        k, a = search.check_top_k(top_k), search.check_alpha(self.alpha if alpha is None else alpha)
        docs = self.store.scan(filters, vectors=True)
        if docs is None:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, score double, id string, content string")
        corpus = docs.withColumnRenamed("id", "doc_id")
        words, near = corpus.select("doc_id", "content"), corpus.select("doc_id", "embedding")
        if self.mode == "keyword":
            hits = search.bm25(words, queries, k)
        elif self.mode == "vector":
            hits = search.vector_search(near, self.embedder.queries(queries), k)
        else:
            hits = search.fuse(search.bm25(words, queries, 10 * k), search.vector_search(near, self.embedder.queries(queries), 10 * k), a, k)
        found = docs if vectors else docs.drop("embedding")
        return hits.withColumnRenamed("doc_id", "id").join(found, "id")

    def retrieve(self, query: str, **options: Any) -> DataFrame:
        """The results of one query, best first."""
        one = self.store.spark.createDataFrame([(0, query)], "query_id long, query string")
        return self.retrieve_many(one, **options).drop("query_id").orderBy("rank")


#: The keys that a configuration may have.
ROOT_KEYS = ("mode", "alpha", "store", "embedding")
STORE_KEYS = ("collection", "root")
EMBEDDING_KEYS = ("backend", "model", "base_url", "api_key", "timeout", "query_prefix", "document_prefix", "batch_size", "max_length", "skip_prefix_if_present", "encoding_format", "extra_body")


def _section(config: Any, keys: tuple[str, ...], name: str) -> dict:
    if not isinstance(config, Mapping):
        raise ConfigError(f"{name} must be a mapping")
    if odd := sorted(set(map(str, config)) - set(keys)):
        raise ConfigError(f"{name} has unknown keys: {', '.join(odd)}")
    return dict(config)


class Runtime:
    """Store, indexer and retriever as one configuration names them. ``backends`` are the local encoders: a name gives a plug-in."""

    def __init__(self, spark: SparkSession, config: Mapping[str, Any], backends: Mapping[str, Call] | None = None):
        c = _section(config, ROOT_KEYS, "retrieval")
        s = _section(c.get("store"), STORE_KEYS, "store")
        if not isinstance(s.get("collection"), str) or not s["collection"].strip():
            raise ConfigError("store.collection must be a name")
        try:
            alpha = search.check_alpha(c.get("alpha", 0.5))
        except ValueError as e:
            raise ConfigError(str(e)) from e
        embedder = None
        if c.get("mode") != "keyword" and "embedding" in c:
            embedder = self._embedder(_section(c["embedding"], EMBEDDING_KEYS, "embedding"), backends or {})
        self.store = Collection(spark, s.get("root") or f"{files.shared_dir(spark)}/collections", s["collection"])
        self.retriever = Retriever(self.store, c.get("mode"), embedder, alpha)
        self.indexer = Indexer(self.store, embedder)
        self.index, self.retrieve, self.retrieve_many = self.indexer.index, self.retriever.retrieve, self.retriever.retrieve_many

    @staticmethod
    def _embedder(e: dict, backends: Mapping[str, Call]) -> Embedder:
        profile = Profile(**{k: e[k] for k in ("query_prefix", "document_prefix", "batch_size", "max_length", "skip_prefix_if_present") if e.get(k) is not None})
        if e.get("backend") == "local":
            if e.get("model") not in backends:
                raise ConfigError(f"no local encoder {e.get('model')!r}")
            return Embedder(backends[e["model"]], profile)
        if e.get("backend") != "remote" or not e.get("base_url") or not e.get("model"):
            raise ConfigError("embedding needs the backend local or remote, the latter with base_url and model")
        post = partial(http_post, f"{e['base_url'].rstrip('/')}/embeddings", e.get("api_key"), e.get("timeout", 30.0))
        return Embedder(remote_call(e["model"], post, e.get("encoding_format"), e.get("extra_body")), profile)


def _request(payload: Any, allowed: tuple[str, ...]) -> dict:
    if not isinstance(payload, Mapping):
        raise RequestError("a JSON object is needed")
    if odd := sorted(set(map(str, payload)) - set(allowed)):
        raise RequestError(f"unknown fields: {', '.join(odd)}")
    return dict(payload)


def _whole(payload: dict, name: str, default: int) -> int:
    try:
        return positive(default if payload.get(name) is None else payload[name], name)
    except ConfigError as e:
        raise RequestError(str(e)) from e


def search_request(payload: Any) -> dict:
    """Checked fields of a search: ``text`` without outer white space, ``top_k``, ``filter_by``."""
    p = _request(payload, ("text", "top_k", "filter_by"))
    if not isinstance(p.get("text"), str) or not p["text"].strip():
        raise RequestError("text is missing or empty")
    if p.get("filter_by") is not None and not isinstance(p["filter_by"], Mapping):
        raise RequestError("filter_by is no object")
    return {"text": p["text"].strip(), "top_k": _whole(p, "top_k", 5), "filter_by": p.get("filter_by")}


def index_request(payload: Any) -> dict:
    """Checked fields of an indexing request: the name of a dataset or a list of objects with text contents."""
    p = _request(payload, ("dataset_name_or_docs", "batch_size"))
    source = p.get("dataset_name_or_docs")
    named = isinstance(source, str) and source.strip()
    listed = isinstance(source, list) and all(isinstance(x, Mapping) and isinstance(x.get("content"), str) for x in source)
    if not named and not listed:
        raise RequestError("dataset_name_or_docs is neither a name nor a list of documents")
    return {"dataset_name_or_docs": source, "batch_size": _whole(p, "batch_size", 64)}


def delete_request(payload: Any) -> dict:
    """A request to delete takes no fields."""
    return _request(payload, ())
