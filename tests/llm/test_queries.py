"""The registered queries themselves: columns, types and digests, on small tables."""

import hashlib
import random
import re

import pytest
import test_llm as T
import xxhash
from pyspark.sql import functions as F

from quarryloom.llm import mixing, registry

COLUMNS = {
    "op1_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op2_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op4_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op5_html_extract": "page_id:bigint url:string text:string n_chars:bigint",
    "op6_chat_format": "conv_id:bigint n_turns:bigint copies:bigint text:string n_chars:bigint",
    "op7_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op8_line_dedup": "doc_id:bigint n_lines:bigint n_removed:bigint n_kept_chars:bigint kept_sha256:string",
    "op9_nearest": "query_id:bigint rank:int vec_id:bigint score:double",
    "op10_simhash_dedup": "doc_id:bigint fingerprint:string component_id:bigint",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    top = tmp_path_factory.mktemp("tables")
    passage = T.prose(rng, 60)
    docs = [(i, T.prose(rng, 30) + ("\n" + passage if i % 7 == 0 else "") + (" vlimex grontul vlimex skarp" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(120)]
    docs += [(200, docs[1][1], "en", "s0", 0), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, "x", "en", "s1", 0)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    put("documents", docs, T.DOC)
    put("labels", [(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    put("benchmark", [(0, " ".join(docs[5][1].split()[3:20])), (1, "nowhere " * 9)], "item_id long, text string")
    put("pages", [(i, f"https://a.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'de'}/{i}", f"<article><h1>T{i}</h1><p>{T.LONG}</article>") for i in range(40)] + [(99, None, None)], "page_id long, url string, html string")
    put("conversations", [(c, t, "user", f"t{t}") for c in range(6) for t in range(c % 3 + 1)], "conv_id long, turn long, role string, text string")
    put("embeddings", [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "vec_id long, embedding array<float>")
    return str(top), docs


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, tables, name):
    found = registry.QUERIES[name](spark, tables[0])
    kinds = dict(found.dtypes)
    for c in COLUMNS[name].split():
        column, kind = c.split(":")
        assert kinds[column] == kind
    rows = found.collect()
    if "doc_id" in kinds:
        assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in tables[1])
    if name == "op3_suffix_dedup":
        want = T.removed_by_hand([(d[1] or "").encode() for d in tables[1]])
        by = {d[0]: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in zip(tables[1], want)}
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == by and sum(x[1] for x in by.values()) > 0
    if name == "op10_simhash_dedup":
        for r in rows:
            words = (dict((d[0], d[1]) for d in tables[1])[r["doc_id"]] or "").lower().split()
            grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
            h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
            assert r["fingerprint"] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
        assert {r["doc_id"]: r["component_id"] for r in rows}[200] == 1
    if name == "op4_decontaminate":
        hit = {r["doc_id"]: r for r in rows}[5]
        assert (hit["n_hit"], hit["n_items"], hit["items_sha256"], hit["contaminated"]) == (17, 1, hashlib.sha256(b"0").hexdigest(), False)
    if name == "op5_html_extract":
        assert {r["text"] for r in rows} == {"", *(f"T{i}\n{T.LONG}" for i in range(40))} and all(r["n_chars"] == len(r["text"]) for r in rows)
    if name == "op8_line_dedup":
        gone = {r["doc_id"]: r["n_removed"] for r in rows}
        assert gone[0] == 0 and gone[7] == gone[14] == gone[200] == 1 and sum(gone.values()) == 18
    if name == "op1_mixing":
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert {r["doc_id"]: r["size"] for r in rows} == {d[0]: size(d[1]) for d in tables[1]}


def test_shards_hold_the_mixture(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    mixture = mixing.mix(docs, block_words=64, shard_words=500)
    mixing.write_shards(mixture, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "_epoch", F.col("_shard").cast("int"), "_words").collect()), key=str)
    assert key(back) == key(mixture) and len(list((tmp_path / "shards").glob("_shard=*"))) > 3
