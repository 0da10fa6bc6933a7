"""SentencePiece, fill-in-the-middle and the prefix trie against the library and brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from tempora.llm import fill_in_middle, prefix_trie, sentence_pieces

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
ALPHABET = " \t\n▁aàé日本語😀x​\x00ABC012 ½ﬁ㍿　ｶﾞ\x01‍İ</s>�\xa0"
ODD = [None, "", " ", "  a  b ", "▁", " " * 200, "a" * 300, "日本" * 200, "</s><0x41>", "　　", "​", " ​ ", "ab" * 3000, "<P>", "a<M>b", "<"]
TEXTS = [*ODD, *("".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(300))]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, -1, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], -1, "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int, ids string").repartition(3)


def normalisations(tmp_path):
    """The model with other character maps and rules for blanks."""
    yield MODEL
    for rule in ("nmt_nfkc", "nmt_nfkc_cf"):
        source = proto.ModelProto()
        source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        for trimmed, prefixed in ((True, True), (True, False), (False, True), (False, False)):
            model = proto.ModelProto()
            with open(MODEL, "rb") as f:
                model.ParseFromString(f.read())
            spec = model.normalizer_spec
            spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = source.normalizer_spec.precompiled_charsmap, trimmed, prefixed
            path = tmp_path / f"{rule}{trimmed}{prefixed}.model"
            path.write_bytes(model.SerializeToString())
            yield str(path)


def test_ids_spans_and_texts_are_the_librarys(tmp_path):
    for path in normalisations(tmp_path):
        lib, model, at = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.load(path), 0
        batch = pa.record_batch([pa.array(TEXTS, pa.string())], names=["t"])
        for part, ids, begins, ends, starts in sentence_pieces.encoded_batches([batch], path, "t", False):
            texts = sentence_pieces.decoded(ids, starts, model).to_pylist()
            for r in range(part.num_rows):
                own, want = slice(starts[r], starts[r + 1]), lib.encode(TEXTS[at] or "", return_type="proto").pieces
                assert ids[own].tolist() == [p.id for p in want]
                assert list(zip(begins[own].tolist(), ends[own].tolist(), strict=True)) == [(p.begin, p.end) for p in want]
                assert texts[r].decode() == lib.decode(ids[own].tolist())
                at += 1
        assert at == len(TEXTS)


def test_sentence_pieces_of_tables(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "n", "begins", "ends", "ids", "decoded"] or set(out.columns) == {"doc_id", "text", "n", "ids", "begins", "ends", "decoded"}
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in rows:
        want = lib.encode(r.text or "")
        assert list(r.ids) == [*want, 2] and r.decoded == lib.decode(want) and r.n == -1
        assert r.begins[-1] == r.ends[-1] == len((r.text or "").encode())
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0
    odd = spark.createDataFrame([([5, None, 40_000, -3, 13],), (None,), ([],), ([230, 2, 259],), ([198, 198, 259],)], "ids array<int>")
    got = [r.decoded for r in sentence_pieces.decode(odd.coalesce(1), MODEL).collect()]
    assert got == [lib.decode([5, 13]), "", "", lib.decode([230, 2, 259]), lib.decode([198, 198, 259])]


def test_long_stretches_merge_as_short_ones():
    model = sentence_pieces.load(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in (1, 47, 48, 49, 5000):
        text = "".join(RNG.choice("etaoinshr") for _ in range(n))
        assert model.encoded("▁" + text)[0] == lib.encode(text)
    assert max(map(len, model.ids)) <= sentence_pieces.SHORT


def brute_middle(key, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < 20 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle(spark, docs):
    rows = fill_in_middle.restore(fill_in_middle.transform(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in rows:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute_middle(r.doc_id, r.text) and r.restored == (r.text or "") and r.ids == "clash"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).count() == 0
    every = fill_in_middle.transform(docs, share=100, suffix_first=100).where("form <> 'spm'").collect()
    assert every and all(not r.text or re.search("<[PSM]>", r.text) for r in every)
    odd = spark.createDataFrame([(None, None), ("a<P>b", "plain"), ("<P>a<S>c<M>b", "psm"), ("<S>c<P>a<M>", "spm")], "output string, form string").coalesce(1)
    assert [r.restored for r in fill_in_middle.restore(odd).collect()] == ["", "a<P>b", "abc", "ac"]


def brute_trie(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    seq, members = {}, defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = own.get(c - c % 100, [])[:h] + v[h:] if rebuild else v
    for c in sorted(seq):
        for d in range(len(seq[c]) + 1):
            members[tuple(seq[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k, m: sha(",".join(str(c) for c in m if len(seq[c]) == len(k)))
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def conversations():
    turns = lambda c: [(c, t if RNG.random() > 0.05 else None, RNG.choice(["user", "assistant", None]), RNG.choice(["a", "é日", None, "bb"])) for t in range(RNG.randint(1, 9))]
    mixed = [x for c in [*range(70), 100, 130, 205, -7, -100, 3001] for x in turns(c)] + [(None, 1, "a", "b")]
    # three copies, one that ends inside them, and one that leaves them
    deep = [(c, t, "u", str(t)) for c in (1, 2, 3) for t in range(40)] + [(4, t, "u", str(t)) for t in range(21)] + [(5, t, "u", str(t) if t < 33 else "x") for t in range(50)]
    repeated = [(7, 1, "u", "same"), (7, 1, "u", "same"), (8, 1, "u", "same"), (8, None, "u", "")]
    return [(mixed, True), (mixed, False), (deep, False), (repeated, False), ([(5, 1, "a", "b")], True), ([(5, 1, "a", "b")], False), ([], True)]


@pytest.mark.parametrize("case", range(7))
def test_trie(spark, case):
    rows, rebuild = conversations()[case]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, node string").repartition(3)
    parts = (prefix_trie.rebuilt_turns if rebuild else prefix_trie.own_turns)(df)
    assert sorted(map(tuple, prefix_trie.trie(*parts, block=4).collect())) == brute_trie(rows, rebuild)


def test_digests_of_many_members_are_packed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ends = spark.range(500).select((F.col("id") % 3).alias("depth"), (F.col("id") % 2).alias("node"), F.col("id").alias("conv"))
    got = {(r.depth, r.node): r.ends_sha256 for r in prefix_trie._joined_digests(ends).collect()}
    assert got == {(d, n): sha(",".join(str(i) for i in range(500) if i % 3 == d and i % 2 == n)) for d in range(3) for n in range(2)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_sentence_pieces", "op12_fill_in_middle", "op13_prefix_trie"])
def test_registered_query(spark, name):
    """The queries over the smallest tables: against their SQL, op11 against the library."""
    import duckdb

    from tempora.llm import queries

    df = queries.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "conversations"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        order = sorted(want.columns)
        assert order == sorted(df.columns)
        assert Counter(tuple(r[k] for k in order) for r in rows) == Counter(tuple(dict(zip(want.columns, x, strict=True))[k] for k in order) for x in want.fetchall())
        return
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        pieces = lib.encode(texts[r["doc_id"]], return_type="proto").pieces
        ids = [*(p.id for p in pieces), 2]
        spans = np.array([*((p.begin, p.end) for p in pieces), 2 * (len(texts[r["doc_id"]].encode()),)], "<i4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
        assert r["spans_crc32"] == zlib.crc32(spans.tobytes())
