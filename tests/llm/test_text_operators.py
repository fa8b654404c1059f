"""Operators 1, 3, 4, 6 and 10 against plain statements of their contracts."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from lectern.llm import decontaminate, queries, simhash, simple8b, tokens, tokenstore
from lectern.llm.bytepair import vocabulary

ODD = [None, "", " ", "\n\n", "a", "I'll don't 'S x's's  <|endoftext|><|endoftext|>y", "naïve café 　ok 😀é", "!!  1234½٣ \t\r\n x", "word " * 30_000, "é" * 5000]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_words int")


def ranks():
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


LIBRARY = Tokenizer.from_file(public_tokenizers.path(queries.JSON))
RANKS = ranks()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def brute_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            for b in range(len(own) - n + 1):
                if own[b : b + n] == w[a : a + n]:
                    hit |= {*range(b, b + n)}
                    found.add(str(i))
    return len(own), hit, sorted(found)


def test_decontamination_matches_brute_force(spark, sf_dir):
    got = rows(queries.op1_decontaminate(spark, sf_dir))
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    docs = documents(sf_dir)
    assert len(got) == len(docs)
    assert sum(r["contaminated"] for r in got.values()) > 0
    for d in [*docs[:10], *[d for d in docs if got[d["doc_id"]]["contaminated"]]]:
        n, hit, found = brute_hits(d["text"], items)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, len(hit), len(found), sha(",".join(found).encode()))


def test_decontamination_offsets_groups_and_odd_input(spark):
    items = [(1, "One, two three"), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "x y"), (3, None), (4, "...."), (5, "one two THREE"), (1, "nine")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = "Été one-two  THREE! and beta gamma delta epsilon zeta eta theta iota kappa lambda mu; nine x y"
    docs = frame(spark, [text, *ODD])
    for size in (1 << 20, 1):  # one automaton, and one for each pattern
        out = rows(decontaminate.find(docs, bench, most_nodes=size))
        assert len(out) == len(ODD) + 1
        r = out[0]
        assert (r["n_words"], r["items"]) == (19, ["1", "2", "5"])
        raw = text.encode()
        assert [raw[s["start"] : s["end"]].decode() for s in r["spans"]] == ["one-two  THREE", "beta gamma delta epsilon zeta eta theta iota kappa lambda", "nine"]
        n, hit, found = brute_hits(text, [i for i in items if i[0] is not None])
        assert r["hit_words"] == sorted(hit) and r["items"] == found and r["n_words"] == n
        assert out[1]["n_words"] == 0 and out[1]["hit_words"] == []
    none = rows(decontaminate.find(docs, bench.limit(0)))
    assert all(not r["items"] for r in none.values())
    assert decontaminate.find(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name,library", [(queries.RANKS, RANKS.encode_ordinary), (queries.JSON, lambda t: LIBRARY.encode(t, add_special_tokens=False).ids)])
def test_encoding_matches_library(spark, sf_dir, name, library):
    texts = [*ODD, *[d["text"] for d in documents(sf_dir)[:60]]]
    got = rows(tokens.encode(frame(spark, texts), public_tokenizers.path(name), decoded="decoded"))
    for k, t in enumerate(texts):
        assert got[k]["ids"] == library(t or "")
        assert bytes(got[k]["decoded"]) == (t or "").encode()


def test_bpe_query(spark, sf_dir):
    got = rows(queries.op3_byte_bpe(spark, sf_dir))
    for d in documents(sf_dir):
        ids = RANKS.encode_ordinary(d["text"])
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(d["text"].encode()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "'", "é", "中", "1", "½", "!", "\x1c", "\x85", " ", "I'M"]) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join))
def test_any_text_encodes_as_the_library(text):
    from lectern.llm.bytepair import Pieces
    from lectern.llm.common import text_buffer

    import pyarrow as pa

    v = vocabulary(public_tokenizers.path(queries.RANKS))
    p = Pieces(*text_buffer(pa.array([text], pa.string())))
    assert [i for c in p.codes for i in v.encode_piece(p.distinct[c])] == RANKS.encode_ordinary(text)


def test_append_edit_and_prefix_counts():
    v = vocabulary(public_tokenizers.path(queries.RANKS))
    text = b"retitioninganthouendblewhstthreainterrestionallyunderstandinghyperextension"
    table = v.prefix_table(text)
    assert v.append(text[:20], v.prefix_table(text[:20]), text[20:]) == table
    for at, removed, more in ((5, 3, b"xyz"), (0, 0, b"pre"), (30, 10, b""), (len(text), 0, b"s"), (7, 1, b"longer piece")):
        new, edited = v.edit(text, table, at, removed, more)
        assert new == text[:at] + more + text[at + removed :]
        assert edited == v.prefix_table(new)
    assert v.prefix_counts(text) == [len(v.encode_piece(text[:k])) if k else 0 for k in range(len(text) + 1)]


def test_token_counts(spark, sf_dir):
    got = rows(queries.op6_token_counts(spark, sf_dir))
    for d in documents(sf_dir):
        e = LIBRARY.encode(d["text"], add_special_tokens=False)
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(d["text"].encode()), len(e.ids), len(e.ids) > 1024)
        if r["over_limit"]:
            v = vocabulary(public_tokenizers.path(queries.JSON))
            assert r["cut_bytes"] == sum(len(v.token_bytes[i]) for i in e.ids[:1024])
    odd = rows(tokens.count(frame(spark, ODD), public_tokenizers.path(queries.JSON), 3))
    v = vocabulary(public_tokenizers.path(queries.JSON))
    for k, t in enumerate(ODD):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert odd[k]["n_tokens"] == len(ids)
        assert odd[k]["cut_bytes"] == sum(len(v.token_bytes.get(i, b"<|endoftext|>")) for i in ids[:3])


def test_counts_of_prefixes_and_cuts_need_no_encoding(spark, monkeypatch):
    from lectern.llm.bytepair import Pieces
    from lectern.llm.common import text_buffer

    import pyarrow as pa

    v = vocabulary(public_tokenizers.path(queries.JSON))
    texts = ["retitioninganthouendblewh's 123 naïve  x", "", "understanding hyperextension <|endoftext|>é", "aaaaaaaaaaaaaaaaaaaa bbbbb"]
    cache, buffers = tokens._prefixes(v), text_buffer(pa.array(texts))
    p = tokens.PrefixCounts(*buffers, v, cache)
    monkeypatch.setattr(v, "tables", None)  # all is stored by now
    for row, t in enumerate(texts):
        raw = t.encode()
        own = Pieces(*text_buffer(pa.array([t])), v.special)
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        for b in range(len(raw) + 1):
            want = 0
            for a, c in zip(own.starts, own.codes):
                inside = min(b, a + len(own.distinct[c])) - a
                if inside > 0:
                    part = own.distinct[c][:inside]
                    want += 1 if b"<|endoftext|>".startswith(part) and a in [x for x, _ in own.special] else brute_merge(v, part)
            assert p.at(np.full(len(texts), b))[row] == want
        for limit in range(1, len(ids)):
            assert p.cut(row, limit) == sum(len(v.token_bytes.get(i, b"<|endoftext|>")) for i in ids[:limit])


def brute_merge(v, data):
    """Number of tokens by merging the earliest pair again and again."""
    parts = [v.id_of[data[k : k + 1]] for k in range(len(data))]
    made = {pair: i for i, pair in v._parts.items()}
    while found := [(v._rank[made[x]], k) for k, x in enumerate(zip(parts, parts[1:])) if x in made]:
        _, k = min(found)
        parts[k : k + 2] = [made[parts[k], parts[k + 1]]]
    return len(parts)


def test_tokens_at_a_column_of_positions(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "hello world", None), (3, None, 4), (4, "hello world", 999), (5, "hello world", -3)], "doc_id long, text string, b int")
    got = rows(tokens.count(df, public_tokenizers.path(queries.JSON), 1024, at="b"))
    assert [got[k]["tokens_at"] for k in range(1, 6)] == [1, 2, 0, 2, 0]


def test_other_patterns_are_refused(spark, tmp_path):
    import json

    with pytest.raises(ValueError):
        tokens.encode(frame(spark, ODD), public_tokenizers.path(queries.RANKS), pattern=r"\w+|\W+")
    with open(public_tokenizers.path(queries.JSON), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        at = tmp_path / "changed.json"
        at.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            vocabulary.__wrapped__(str(at))
        with pytest.raises(ValueError):
            tokenstore._library.__wrapped__(str(at))


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for v in (r.integers(0, 50257, n), np.zeros(n), r.integers(0, 2**63, n), np.where(r.random(n) < 0.05, 2**62 + 5, r.integers(0, 9, n))):
            assert (simple8b.unpack(simple8b.pack(v.astype(np.uint64))) == v.astype(np.uint64)).all()


def test_token_store(spark, sf_dir, tmp_path):
    got = rows(queries.op10_token_store(spark, sf_dir))
    start = 0
    for d in sorted(documents(sf_dir), key=lambda d: d["doc_id"]):
        ids = LIBRARY.encode(d["text"], add_special_tokens=False).ids + [0]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokenstore.write(frame(spark, ODD).unionByName(spark.createDataFrame([(None, "null id", "", 0), (3, "again", "", 0)], "doc_id long, text string, ids string, n_words int")), public_tokenizers.path(queries.JSON), str(tmp_path / "odd"))
    back = sorted(tokenstore.read(spark, str(tmp_path / "odd")).collect(), key=lambda r: r["start"])
    want = sorted([(-1, "null id"), (3, "again"), *enumerate(ODD)], key=lambda x: (x[0], x[1] or ""))
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in back] == [LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for _, t in want]
    assert back[0]["doc_id"] is None and back[0]["start"] == 0


def brute_fingerprint(text):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").strip(" \t\n\x0b\x0c\r"))
    words = [w for w in words if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    return find


def test_simhash(spark, sf_dir):
    got = rows(queries.op4_simhash(spark, sf_dir))
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in documents(sf_dir)}
    find, least = brute_components(fps.values()), {}
    for i, f in sorted(fps.items()):
        least.setdefault(find(f), i)
    for i, f in fps.items():
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", least[find(f)])
    assert len(least) < len(fps)


def test_simhash_odd_and_cut_subtrees(spark):
    got = rows(simhash.groups(frame(spark, ODD)))
    assert [got[k]["component_id"] for k in range(4)] == [0] * 4
    assert simhash.groups(frame(spark, ODD).limit(0)).count() == 0
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 6, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in r.integers(0, 64, 3)) for c in centre for _ in range(60)]
    fps = sorted(set(near) | {int(x) for x in r.integers(0, 2**63, 100)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").withColumn("id", F.col("fp"))
    find = brute_components(fps)
    for most in (1 << 14, 16):
        edges = [(int(np.int64(e["a"]).view(np.uint64)), int(np.int64(e["b"]).view(np.uint64))) for e in simhash.links(df, most=most).collect()]
        root = {f: f for f in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            assert find(a) == find(b)
            root[top(b)] = top(a)
        assert len({top(f) for f in fps}) == len({find(f) for f in fps})


def test_workers_keep_no_pieces_of_a_past_encoding(spark):
    """Spark keeps its Python workers: what they hold on to adds to the memory of the stages that follow."""

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"kept": pa.array([sum(len(c._known) for k, c in tokens._caches.items() if k[0] is tokens._ids)], pa.int64())})

    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text")
    done = tokens.encode(docs, public_tokenizers.path(queries.RANKS), decoded="decoded")
    assert done.where("decoded = cast(text AS binary)").count() == 4000
    assert {x.kept for x in spark.range(0, 16, 1, 16).mapInArrow(kept, "kept long").collect()} == {0}
