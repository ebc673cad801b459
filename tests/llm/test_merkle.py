"""The Merkle manifest against a plain version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from pitspark.llm import merkle
from test_filters import rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(levels):
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)])
    return levels


def plain(table):
    """table: (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in table:
        def leaf(t):
            return sha("".join(map(enc, (doc_id, source, lang, n, t))))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        forged = leaf(text.translate(brute.LOWER) if text is not None else None) if hit else leaf(text)
        groups[source].append((doc_id is not None, doc_id or 0, leaf(text), forged, doc_id))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [up([[r[2] for r in sorted(groups[s])]]) for s in sources]
    top = up([[t[-1][0] for t in trees]])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, forged, doc_id) in enumerate(sorted(groups[s])):
            digest, proof = forged, ""
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    a = at - at % 16
                    left, right = "".join(level[a:at]), "".join(level[at + 1:a + 16])
                    proof += left + right
                    digest, at = sha(left + digest + right), at // 16
            root = top[-1][0]
            out.append((doc_id, leaf, trees[k][-1][0], root, sha(proof), digest, digest == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, leaf string, index int, tree int, height int, path string"


def frame(spark, table):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in table], DDL)


def test_manifest_of_awkward_rows(spark):
    table = [
        (i, t, None if k % 3 else "é", ["a", "b", None, "Z", "é", ""][k % 6], k if k % 2 else None)
        for k, (i, t) in enumerate(brute.awkward_texts())
    ]
    table += [(2**60 + 1, "Big ID", "en", "a", 1)] * 3 + [(None, None, None, None, None)] * 20
    assert rows(merkle.manifest(frame(spark, table)), *COLUMNS) == plain(table)


@pytest.mark.parametrize("n_hot", [16, 17, 300])
def test_manifest_over_superblocks(spark, monkeypatch, n_hot):
    monkeypatch.setattr(merkle, "STEPS", 1)
    monkeypatch.setattr(merkle, "_SHIFT", 4)
    table = [(i, f"Text {i}", "en", "hot", i) for i in range(n_hot)] + [(i, "T", "en", f"s{i:03}", 1) for i in range(20)]
    table += [(7, "Same Row", "en", "rep", 1)] * 40
    assert rows(merkle.manifest(frame(spark, table)), *COLUMNS) == plain(table)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(frame(spark, []).limit(0)).count() == 0
    for table in ([(5, "A", None, "s", 1)], [(5, "A", None, "s", 1), (5, None, None, None, 1)]):
        assert rows(merkle.manifest(frame(spark, table)), *COLUMNS) == plain(table)
