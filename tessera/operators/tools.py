"""What an AI reader may call. Every tool takes its documents through policy.visible(), here and nowhere else.

Standards are found by name and path, with their validity and without an excerpt; readers who have
opted into searching standards get the excerpt. Whole standards are never read, merged or copied, and
no folder lists them, whatever the reader has opted into. documents: id, name, path, project, text;
entries of the index: the same without text, with norm (boolean) and, of standards, status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import documents, norms, search
from tessera.operators.policy import Policy, visible


def _no_norms(docs: DataFrame, policy: Policy, norm: Column | None) -> DataFrame:
    return visible(docs, policy).where(~(norms.is_norm(F.coalesce("text", F.lit(""))) if norm is None else norm))


def find(index: search.Index, docs: DataFrame, policy: Policy, query: str, norm_search: bool = False, k: int = search.HITS) -> DataFrame:
    """search: id, score, name, path, project, status, excerpt of at most k hits and never more than HITS; counts and weights know of visible documents only."""
    k = max(1, min(k, search.HITS))
    seen = index.restricted(lambda entries: visible(entries, policy))
    hits = search.described(search.search(seen, query, k=k), seen, "norm", "status")
    found = search.with_excerpts(hits, docs, query, k=k)
    return norms.redacted(found, F.col("norm"), norm_search).drop("norm")


def read_document(docs: DataFrame, policy: Policy, norm: Column | None = None) -> DataFrame:
    """read_document: id, block_no, text."""
    return documents.read_blocks(_no_norms(docs, policy, norm))


def list_folder(docs: DataFrame, policy: Policy, folder: str, norm: Column | None = None) -> DataFrame:
    """list_folder: name, kind."""
    return documents.list_folder(_no_norms(docs, policy, norm), folder)


def resolve(docs: DataFrame, policy: Policy, ids: Sequence[int]) -> DataFrame:
    """open_file and reveal_file: id, path."""
    return documents.resolve_ids(visible(docs, policy), ids)


def merge(docs: DataFrame, policy: Policy, ids: Sequence[int], ext: str = "pdf", norm: Column | None = None) -> DataFrame:
    """merge_documents_to_pdf: position, id, path."""
    return documents.merge_selection(_no_norms(docs, policy, norm), ids, ext)


def copy(docs: DataFrame, policy: Policy, ids: Sequence[int], norm: Column | None = None) -> DataFrame:
    """copy_documents_to_folder: position, id, path."""
    return documents.copy_selection(_no_norms(docs, policy, norm), ids)
