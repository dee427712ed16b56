"""Operator 12 against whole-text encodings, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import op12_alignment as op12

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(docs: dict) -> dict:
    """doc_id -> the contract's row, straight from whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back, alphabet = {i: p for p, i in a.get_vocab().items()}, op12.byte_alphabet()
    found, counts = {}, Counter()
    for doc_id, text in docs.items():
        found[doc_id] = ([], [], [])
        if not text:
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(alphabet[c] for c in back[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, mine = 0, []
            for p in parts:
                at += len(p)
                mine.append(at)
            ends.append(mine)
        last = dict(zip(ends[1], range(1, len(ids_b) + 1), strict=True))
        links = [(x, ids_b[last[e] - 1]) for x, e in zip(ids_a, ends[0], strict=True) if e in last]
        counts.update(links)
        groups, i, j = [], 0, 0
        for p, cut in enumerate(ends[0], 1):
            if cut not in last:
                continue
            q = last[cut]
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            i, j = p, q
        found[doc_id] = (ids_a, ids_b, links, ";".join(groups))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return {
        k: (len(v[0]), len(v[1]), len(v[2]), len(v[2]), sum(counts[x] == top[x[1]] for x in v[2]), sum(counts[x] for x in v[2]), hashlib.sha256(v[3].encode()).hexdigest() if v[0] else "")
        for k, v in found.items()
    }


def rows(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    links = op12.written(op12.document_links(df.repartition(3), A, B), "test-links")
    out = op12.with_counts(links, op12.pair_counts(links)).collect()
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out}


def test_odd_texts_equal_whole_encodings(spark):
    rng = random.Random(5)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日本", "語", "😀", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "<unk>", "ﬁ", "ｆ", " ", "​", "12345", "n't", "'ll", "...", "|", "\x00", "é", "кот", "ا"]
    docs = {k: "".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for k in range(250)} | {900: None, 901: "", 902: " ", 903: "     ", 904: "x " * 30000, 905: "日" * 5000, 906: "q" * 3000}
    want = plain(docs)
    assert rows(spark, docs) == want
    assert any(v[0] == 0 for k, v in want.items() if docs[k]) and sum(v[0] > 0 for v in want.values()) > 100


def test_given_documents_and_spans(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = {r.doc_id: r.text for r in given}
    assert rows(spark, docs) == plain(docs)


def test_empty_table_and_null_ids(spark):
    assert op12.align_texts(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    found = op12.document_links(df, A, B).collect()
    assert len({(r.n_a, r.groups_sha256) for r in found}) == 1 and len(found) == 3


def test_refined_spans():
    # Three byte-fallback tokens, of which the last alone has the character's span; a character split by A.
    assert op12.refined([(0, 1), (1, 1), (1, 1), (1, 4), (4, 6)], [1, 1, 1, 1, 2]) == [1, 2, 3, 4, 6]
    assert op12.refined([(0, 4), (1, 4), (1, 4)], [2, 1, 1]) == [2, 3, 4]
    assert op12.refined([(0, 2), (2, 4)], [1, 3]) is None


def test_byte_alphabet_covers_the_vocabulary():
    alphabet = op12.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256))
    assert sum(set(p) <= alphabet.keys() for p in Tokenizer.from_file(A).get_vocab()) >= 50256
