"""The stored index of a folder's documents: built once an application and version of the table, then read by every query."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import sparse
from fathom.operators.cells import VectorIndex
from fathom.operators.segments import SegmentedIndex
from fathom.session import shared_folder
from fathom.sources.tables import Tables


def version_of(t: Tables, table: str) -> str:
    """A name for the files of a table as they are now."""
    spark, name = t.spark, f"{t.folder}/{table}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in system.listStatus(path))
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]


def documents_index(t: Tables) -> sparse.Index:
    """The index of documents by doc_id, languages being the knowledge bases. Of several that build it at once one counts."""
    index = SegmentedIndex(t.spark, f"{shared_folder(t.spark)}/index-{version_of(t, 'documents')}")
    return index.open() or index.build(t.documents, "doc_id", "text", "lang")


def stemmed_index(t: Tables) -> sparse.Index:
    """The same of English stems without stop words."""
    index = SegmentedIndex(t.spark, f"{shared_folder(t.spark)}/stems-{version_of(t, 'documents')}", stemmer="english", stop_words=text.STOP_WORDS)
    return index.open() or index.build(t.documents, "doc_id", "text", "lang")


def vectors_index(t: Tables) -> VectorIndex:
    """The index of the embeddings by vec_id."""
    index = VectorIndex(t.spark, f"{shared_folder(t.spark)}/vectors-{version_of(t, 'embeddings')}")
    if not index.log.version():
        index.build(t.embeddings.select(F.col("vec_id").alias("item"), "embedding", "label"))
    return index
