"""Long blanks, clashing names, repeated ids, huge components, and folders that nobody shares."""

import base64
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, decontamination, license_scan, mixing, secrets, simhash, topk, toxicity

from .conftest import docs_of
from .test_brute_force import der


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "k8s://somewhere"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_blanks_after_a_first_line_take_linear_time():
    began = time.time()
    for gap in (" " * 1_000_000, "\n" * 1_000_000, "a: " * 300_000, "-----BEGIN PRIVATE KEY-----\n" * 40_000):
        assert secrets.find_spans("-----BEGIN RSA PRIVATE KEY-----" + gap)[1] == []
    assert time.time() - began < 20


def test_encrypted_blocks_and_containers_in_hex():
    block = lambda iv, data: f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{iv}\n\n{base64.b64encode(data).decode()}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [k for k, _, _ in secrets.confirmed_spans(t)]
    assert kinds(block("A1" * 16, bytes(range(160)))) == ["pem"]
    assert kinds(block("A1" * 8, bytes(range(160)))) == kinds(block("A1" * 16, b"hello")) == kinds(block("A1" * 16, bytes(range(161)))) == []
    part = lambda b: len(b).to_bytes(4, "big") + b
    container = b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4, "big") + part(b"public key") + part(b"private key" * 9)
    assert kinds("x " + container.hex() + " y") == ["openssh"] and kinds("x " + container[:40].hex() + " y") == []


def test_long_license_texts_take_linear_time():
    began = time.time()
    n = 40_000
    text = "apache license GPLv3 " * n
    got = license_scan.scan_text(text)
    assert got[1] == n and got[5] == "apache,gpl-3.0" and time.time() - began < 20


def test_ids_that_repeat_with_other_texts(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    made = docs_of(spark, [(1, words[0]), (1, words[1]), (2, words[2]), (3, words[1]), (1, words[0])])
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(made).collect())
    assert got == sorted([(1, words[0]), (1, words[1]), (2, words[2])])


NAMES = ("bad_id", "kept_id", "kept_mark", "its_source", "its_size", "source_size", "target", "size", "copies", "copy", "own_mark", "toxicity_score", "its_doc", "row", "value")


def filters(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30))), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1, 1), (7, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    return {
        "decontaminated": lambda d: decontamination.decontaminated(d, bench),
        "without_toxic": lambda d: toxicity.without_toxic(d, labels),
        "one_of_each": simhash.one_of_each,
        "emit": mixing.emit,
        "redact": secrets.redact,
    }


@pytest.mark.parametrize("name", ["decontaminated", "without_toxic", "one_of_each", "emit", "redact"])
def test_filters_keep_clashing_columns(spark, odd, nothing, name):
    operator = filters(spark)[name]
    extra = odd.select("*", *[F.lit(c).alias(c) for c in NAMES])
    got = operator(extra)
    for c in NAMES:
        if (name, c) not in {("emit", "copy"), ("without_toxic", "toxicity_score")}:
            assert {r[c] for r in got.select(c).collect()} <= {c}
    assert got.count() == operator(odd).count() > 0
    assert operator(nothing).count() == 0
    assert operator(nothing.select("*", *[F.lit(c).alias(c) for c in NAMES])).count() == 0


def test_huge_components(spark):
    made = spark.createDataFrame([(100, [1e10, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e306, 1.0]), (4, [2.0, 0.0]), (5, [1e10, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.search(made, made.where("vec_id = 100"), k=5).orderBy("rank").collect()]
    assert got == [(1, topk.MOST), (3, topk.MOST), (5, topk.MOST), (4, 2048 * 1024 * 10**10), (2, -topk.MOST)]


def test_portions_of_queries(spark, monkeypatch):
    made = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.xxhash64("id", F.lit(k)) % 1000 / 500.0) for k in range(6)]).alias("embedding"))
    want = sorted(map(tuple, topk.search(made, made.where("vec_id % 3 = 0"), k=4).collect()))
    monkeypatch.setattr(topk, "PORTION", 7)
    assert sorted(map(tuple, topk.search(made, made.where("vec_id % 3 = 0"), k=4).collect())) == want


def test_a_der_key_still_counts():
    key = der(0x30, der(2, b"\x00") + b"".join(der(2, bytes([k + 1]) * 20) for k in range(8)))
    assert [k for k, _, _ in secrets.confirmed_spans(f"k {key.hex()}")] == ["der"]


def test_archives_are_members_with_digests(spark, tmp_path, monkeypatch):
    """Every member of a file is one record; ids are unique; digests and lengths hold; also without a broadcast."""
    import gzip
    import hashlib
    import zlib

    from palimpsest.llm import warc

    made = spark.createDataFrame([(i, f"http://h/{i}", "<p>" if i % 3 == 0 else f"<p>{i}é") for i in range(40)] + [(1, "http://h/again", "other")], "page_id long, url string, html string")
    for limit in (warc.BROADCAST_FLAGS, 0):
        monkeypatch.setattr(warc, "BROADCAST_FLAGS", limit)
        folder = tmp_path / str(limit)
        warc.write_archives(made, f"file://{folder}")
        ids, kinds = [], []
        for file in folder.iterdir():
            assert file.name.endswith(".warc.gz")
            data = file.read_bytes()
            while data:
                member = zlib.decompressobj(31)
                text = member.decompress(data)
                assert member.eof
                data = member.unused_data
                ((headers, block),) = warc.parse(gzip.compress(text))
                ids.append(headers["warc-record-id"])
                kinds.append(headers["warc-type"])
                if kinds[-1] != "warcinfo":
                    assert headers["warc-block-digest"] == "sha1:" + warc.base32(hashlib.sha1(block).digest())
        assert len(ids) == len(set(ids)) and kinds.count("revisit") == 13 and kinds.count("response") == 28
        got = {(r.page_id, r.refers_to) for r in warc.resolve(warc.read_archives(spark, f"file://{folder}")).where("record_type = 'revisit'").collect()}
        assert got == {(i, 0) for i in range(3, 40, 3)}
