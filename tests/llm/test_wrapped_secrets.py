"""Keys that are escaped, wrapped or encoded once more."""

import base64
import json
import textwrap

import pytest

from palimpsest.llm import secrets

from .test_brute_force import der

KEY = der(0x30, der(2, b"\x00") + b"".join(der(2, bytes([60 + 9 * k]) * 40) for k in range(8)))
B64 = base64.b64encode(KEY).decode()
WRAPPED = "\n".join(textwrap.wrap(B64, 64))
PEM = f"-----BEGIN RSA PRIVATE KEY-----\n{WRAPPED}\n-----END RSA PRIVATE KEY-----\n"
TEXTS = {
    "escaped": (json.dumps({"private_key": PEM}), "pem"),
    "escaped_slashes": (json.dumps({"private_key": PEM}).replace("/", "\\/"), "pem"),
    "escaped_twice": (json.dumps(json.dumps({"private_key": PEM})), "pem"),
    "encoded_pem": ("tls.key: " + base64.b64encode(PEM.encode()).decode(), "pem"),
    "encoded_pem_wrapped": ("\n".join(textwrap.wrap(base64.b64encode(b"x" + PEM.encode()).decode(), 76)), "pem"),
    "wrapped": (f"the key\n{WRAPPED}\nthanks a lot", "der"),
    "wrapped_escaped": (json.dumps("key\n" + WRAPPED), "der"),
    "plain_pem": (PEM, "pem"),
    "prefixed": ("key/" + B64, "der"),
}


@pytest.mark.parametrize("name", TEXTS)
def test_whole_key_is_found(name):
    text, kind = TEXTS[name]
    assert [k for k, _, _ in secrets.confirmed_spans(text)] == [kind]
    masked = secrets.redacted(text)
    lines = [x for x in WRAPPED.split("\n") if x]
    assert not any(x in masked or x.rstrip("=") in masked for x in lines)
    if name == "wrapped":
        assert masked == "the key\n[secret]\nthanks a lot"


@pytest.mark.parametrize("blank", ["", " ", "\n"])
def test_token_header_may_hold_blanks(blank):
    header = blank + '{' + blank + '"alg": "HS256"}'
    token = ".".join(base64.urlsafe_b64encode(x.encode()).decode().rstrip("=") for x in (header, '{"sub": 1}')) + ".c2lnbmF0dXJlMTIz"
    for text in (token, "example." + token):
        assert [k for k, _, _ in secrets.confirmed_spans(text)] == ["jwt"]


def test_what_is_no_key_stays():
    broken = base64.b64encode(KEY[:-1]).decode()
    for text in (broken, "\n".join(textwrap.wrap(broken, 64)), PEM.replace(B64[:64], B64[64:128]), "a" * 500):
        assert secrets.confirmed_spans(text) == []
