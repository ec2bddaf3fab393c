"""Runs made of nothing but beginnings of keys take time by their length; keys among them are still found."""

import base64
import time

import pytest

from palimpsest.llm import secrets

HEADERS = {
    "der": b"\x30\x82\xff\xff" * 3,
    "der with version": b"\x30\x82\xff\xff\x02\x01\x00\x30\x82\xff\xff\x05",
    "encrypted": b"\x30\x82\xff\xff\x30\x82\xf0\xff\x06\x01\x01\x05",
    "children": b"\x04\x0a\x00\x30\x83\x01\x00\x00\x02\x01\x00\x00",
    "openssh": b"openssh-key-v1\0\0\0\0",
}


@pytest.mark.parametrize("kind", HEADERS)
def test_time_goes_with_length(kind):
    def took(size):
        run = base64.b64encode(HEADERS[kind] * (size // len(HEADERS[kind]))).decode()
        began = time.process_time()
        secrets.find_spans(run)
        return time.process_time() - began

    some, four_times = took(400_000), took(1_600_000)
    assert four_times < 8 * some + 1  # a quadratic scan takes 16 times as long, and a day for a few million characters


def test_keys_between_headers_are_found():
    integer = lambda n: b"\x02" + bytes([len(n)]) + n
    inner = b"".join(integer(x) for x in (b"\x00", *[b"\x11" * 20] * 8))
    key = b"\x30\x81" + bytes([len(inner)]) + inner
    run = base64.b64encode(HEADERS["der"] * 50 + key + b"\0" * (-len(key) % 3) + HEADERS["der"] * 50).decode()
    spans = [x for x in secrets.find_spans(run)[1] if x[0] == "der"]
    start = len(HEADERS["der"]) * 50 * 4 // 3
    assert spans == [("der", start, start + -(-len(key) * 4 // 3))]


def test_stretches_read_what_decoding_all_reads():
    data = bytes(range(256)) * 3
    digits = base64.b64encode(data).decode().rstrip("=")
    whole = secrets.Stretch(digits, 0)
    for a, b in ((0, 0), (0, 1), (1, 5), (2, 300), (700, 768), (767, 768), (5, 2000)):
        assert bytes(whole[a:b]) == data[a:b] and whole[a:b] == data[a:b]
    assert whole[7] == 7 and bytes(whole[10:400][5:8]) == data[15:18] and whole.startswith(b"\0\1\2")
