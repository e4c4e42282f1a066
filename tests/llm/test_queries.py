"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle import compare, connect

from meshledger.llm import registry

NATIVE = ("op2_mixing", "op6_exact_dedup", "op11_secrets")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), registry.QUERIES[name], registry.ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.split("_")[0] not in ("op12", "op13")))
def test_one_row_per_document_or_page(spark, sf_dir, name):
    table = "pages" if name.startswith("op8") else "documents"
    found = registry.QUERIES[name](spark, sf_dir)
    if name in NATIVE:
        plan = found._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        assert after.exceptAll(docs).count() == 0 or name == "mixing"
        kept.append(after.count())
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == kept[-1] > 0
    assert docs.dropDuplicates().exceptAll(spark.read.parquet(str(tmp_path / "decontamination"))).count() == 0


def test_entry_has_all():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_page_text_of_the_test_table_is_its_article(spark, sf_dir):
    import html
    import re

    from meshledger.llm.html_text import main_text

    for _, page in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<(b|/b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert main_text(page) == "\n".join(b for b in blocks if b)


def test_token_ids_of_the_test_table(spark, sf_dir):
    from tokenizers import Tokenizer

    from meshledger.llm.token_files import default_tokenizer

    tokenizer, at = Tokenizer.from_file(default_tokenizer()), 0
    got = {r.doc_id: r for r in registry.QUERIES["op10_token_ids"](spark, sf_dir).collect()}
    for i, text in sorted(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc)
        at += len(ids)
