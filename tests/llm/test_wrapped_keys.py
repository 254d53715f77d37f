"""Keys that are escaped, wrapped or glued to other characters."""

import base64
import json
import random
import textwrap

import pytest
from test_rules import der

from tidemark.llm import secrets


def string(x):
    return len(x).to_bytes(4, "big") + x


def made():
    rng = random.Random(12)
    number = lambda n: b"\x02" + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + b"\x11" + rng.randbytes(n - 1)
    large = der(b"\x02\x01\x00", *[number(n) for n in (257, 3, 256, 129, 129, 129)])
    middle = der(b"\x02\x01\x01", b"\x04\x20" + rng.randbytes(32), number(60), number(60))
    small = der(b"\x02\x01\x00", b"\x30\x05\x06\x03\x2b\x65\x70", b"\x04\x22\x04\x20" + rng.randbytes(32))
    long_form = b"\x30\x81\xa0" + small[2:] * 0 + (b"\x02\x01\x00" + b"\x04\x81\x9a" + rng.randbytes(154))
    three = b"\x30\x83" + (len(large) - 4).to_bytes(3, "big") + large[4:]
    four = b"\x30\x84" + (len(large) - 4).to_bytes(4, "big") + large[4:]
    box = secrets.MAGIC + string(b"none") * 2 + string(b"") + b"\0\0\0\1" + string(rng.randbytes(51)) + string(rng.randbytes(136))
    return [(large, "der"), (middle, "der"), (small, "der"), (long_form, "der"), (three, "der"), (four, "der"), (box, "ssh")]


def spelt(data):
    return base64.b64encode(data).decode()


def found(text, *kinds):
    return [text[a:b] for k, a, b in secrets.spans(text) if k in kinds]


@pytest.mark.parametrize("data, kind", made())
def test_every_form(data, kind):
    plain = spelt(data)
    assert found(f"see {plain} here", kind) == [plain]
    for width in (64, 76):
        for by in ("\n", "\r\n", "\n    ", "\\n", '",\n  "', " \\\n"):
            lines = by.join(textwrap.wrap(plain, width))
            for text in (f"of {lines}", f"key:\n{lines}\nAnd more words", f"internationalization\n{lines}\n"):
                assert found(text, kind) == [lines], text
    for head, tail in [("key-", "-x"), ("a_", "_b"), ("/etc/", "/"), ("x", ""), ("n", "q")]:
        got = found(f"{head}{plain.rstrip('=')}{tail}", kind)
        assert [g.rstrip("=") for g in got] == [plain.rstrip("=")]


@pytest.mark.parametrize("data, kind", made())
def test_escaped_blocks(data, kind):
    body = "\n".join(textwrap.wrap(spelt(data), 64))
    block = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    once = json.dumps({"private_key": block + "\n"})
    for text in (once, json.dumps(once), once.replace("/", "\\/"), block.replace("\n", "\r\n"), block.replace("\n", '\\n" \n "')):
        assert len(found(text, "pem")) == 1, text
    assert len(found(once, kind)) == 1


def test_no_key_is_no_key():
    rng = random.Random(13)
    for data, _ in made()[:-1]:
        broken = data[:-1] if data[1] < 0x80 else data[:40] + rng.randbytes(8) + data[48:-3]
        assert found("k-" + "\n".join(textwrap.wrap(spelt(broken), 64)) + "\n", "der", "ssh", "pem") == []
    assert found("\n".join(spelt(rng.randbytes(48)) for _ in range(500)), "der", "ssh", "pem") == []


def test_two_keys_and_a_long_line():
    (one, _), (two, _) = made()[:2]
    text = f"{spelt(one).rstrip('=')}-{spelt(two)}"
    assert found(text, "der") == [spelt(one).rstrip("="), spelt(two)]
    assert found("x" * 2_000_000 + " " + "yz " * 300_000, "der", "ssh") == []
