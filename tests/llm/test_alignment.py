"""Cross-tokenizer alignment against whole-text encoding, and the perfect hash."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tickerpulse.llm import alignment

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [" ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "\n\n a  b  c", "x　 y", "▁x", "a ▁ b", "<s> <unk> <|endoftext|> don't it's 'll",
       "a\x1c b\x00 c\x85 d", "日本 é́ ﬁ İ \U0001F600 \U0001F600\U0001F600", "a\r\n b;\r c\r d", "\t x\t  y", "x" * 3000, "ab" * 99 + " " + "ba" * 99,
       "foo <0x0A> bar", "   \n\n   ", "same same same", "same same same"]


class Plain:
    """Both tokenizers over whole texts, and dictionaries of counts."""

    def __init__(self, texts):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.bytes_a = lambda i: bytes(byte[c] for c in self.a.id_to_token(i))
        self.rows = [self.align(t) for t in texts]
        self.count = Counter(p for r in self.rows for p in r[3])
        self.best = defaultdict(int)
        for (_, b), n in self.count.items():
            self.best[b] = max(self.best[b], n)

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def align(self, text):
        nothing = (0, 0, "", [])
        if not text:
            return nothing
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        out_a, out_b = list(map(self.bytes_a, a)), list(map(self.bytes_b, b))
        if not b"".join(out_a) == b"".join(out_b) == (" " + text).encode():
            return nothing
        end_a, end_b = ({int(e): k for k, e in enumerate(np.cumsum(list(map(len, x))))} for x in (out_a, out_b))
        groups, pairs, i, j = [], [], 0, 0
        for e in sorted(end_a.keys() & end_b.keys()):
            groups.append(",".join(map(str, a[i:end_a[e] + 1])) + "|" + ",".join(map(str, b[j:end_b[e] + 1])))
            i, j = end_a[e] + 1, end_b[e] + 1
            pairs.append((a[i - 1], b[j - 1]))
        return len(a), len(b), ";".join(groups), pairs

    def expected(self):
        for n_a, n_b, groups, pairs in self.rows:
            yield (n_a, n_b, len(pairs), len(pairs), sum(self.count[p] == self.best[p[1]] for p in pairs), sum(self.count[p] for p in pairs),
                   hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def key(r):
    return tuple(str(x) for x in r)


@pytest.fixture(scope="module")
def table(spark, docs):
    odd = spark.createDataFrame(list(enumerate(ODD, 800_000)), "doc_id long, text string")
    return docs.unionByName(odd, allowMissingColumns=True).repartition(5, "doc_id").persist()


@pytest.mark.parametrize("sizes", [alignment.Sizes(), alignment.Sizes(part_keys=300, block=64, merge=1, branch=2), alignment.Sizes(broadcast_pairs=10)])
def test_equals_whole_text_encoding(table, sizes):
    given = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = [(i, *w) for (i, _), w in zip(given, Plain([t for _, t in given]).expected())]
    got = alignment.digest(alignment.align_documents(table, *PATHS, sizes)).collect()
    assert got[0].asDict().keys() >= {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = {r["doc_id"]: r for r in got}
    assert by[800_000 + ODD.index("▁x")]["n_a"] == 0 and by[800_000 + ODD.index("▁x")]["groups_sha256"] == ""
    assert by[800_000 + ODD.index("same same same")]["n_links"] == 3


def test_groups_and_empty_tables(spark, none):
    assert alignment.align_documents(none, *PATHS).count() == 0
    blank = alignment.align_documents(spark.createDataFrame([(1, None), (None, "")], "doc_id int, text string"), *PATHS)
    assert blank.agg(F.sum("n_a"), F.max("groups")).first()[:] == (0, "")
    aligner = alignment.Aligner(*PATHS)
    (groups,) = alignment.Group(aligner, ["hello world"]).strings()
    assert groups == Plain(["hello world"]).rows[0][2] and groups.count("|") == 2
    assert aligner.cuts and aligner.fast


def test_a_small_memo_changes_nothing(table, monkeypatch):
    texts = [r["text"] for r in table.collect()]
    whole = alignment.Group(alignment.Aligner(*PATHS), texts).strings()
    small = alignment.Aligner(*PATHS)
    monkeypatch.setattr(alignment, "MEMO_STRETCHES", 5)
    got = []
    for t in texts:
        got += alignment.Group(small, [t]).strings()
        if small.full():
            small.clear()
    assert got == whole


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 50, 30_000))
    for n_parts in (1, 7):
        parts = [(p, *alignment.build_part(keys[keys % n_parts == p])) for p in range(n_parts)]
        h = alignment.PerfectHash(n_parts, parts)
        assert h.n == len(keys) and sorted(h.number(keys).tolist()) == list(range(len(keys)))
        assert sum(len(b) for _, _, b in parts) * 8 < 8 * len(keys)  # below a byte a key
        other = np.setdiff1d(rng.integers(0, 1 << 50, 1000), keys)
        assert ((h.number(other) >= -1) & (h.number(other) < h.n)).all()
    assert alignment.PerfectHash(1, []).number(keys[:3]).tolist() == [-1, -1, -1]
