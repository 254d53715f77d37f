"""Keys in hex, encrypted and headed blocks; recall of what the methods add; texts that cost most."""

import base64
import random
import time

import pytest

from tidemark.llm import licenses, secrets


def field(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + head + content


def private_key(draw, size=64):
    numbers = [field(2, bytes([1 + draw.randrange(126)]) + draw.randbytes(size)) for _ in range(5)]
    return field(0x30, field(2, b"\0") + b"".join(numbers))


def encrypted_key(draw):
    method = field(0x30, field(6, bytes.fromhex("2a864886f70d01050d")) + field(0x30, field(4, draw.randbytes(8))))
    return field(0x30, method + field(4, draw.randbytes(128)))


def lines(text, width, mark="\n"):
    return mark.join(text[i : i + width] for i in range(0, len(text), width))


def of(text, *kinds):
    return [(k, text[a:b]) for k, a, b in secrets.spans(text) if k in kinds]


@pytest.mark.parametrize("upper", [False, True])
def test_hex_keys_glued_and_wrapped(upper):
    draw, caught = random.Random(1), 0
    for i in range(60):
        key = private_key(draw, draw.choice([16, 32, 64, 129])).hex()
        key = key.upper() if upper else key
        front, back = draw.choice(["", "a", "0", "ab", "x", "key="]), draw.choice(["", "0", "f", "00", "ff", " end"])
        written = lines(key, draw.choice([60, 64, 76]), draw.choice(["\n", "\\n", "\n> "])) if i % 2 else key
        text = f"some words {front}{written}{back} more"
        caught += of(text, "der") == [("der", written)]
    assert caught == 60


def test_encrypted_headed_and_quoted_blocks():
    draw = random.Random(2)
    plain, cipher = base64.b64encode(private_key(draw)).decode(), base64.b64encode(encrypted_key(draw)).decode()
    begin, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"

    def block(body, name, mark="\n"):
        return begin.format(name) + mark + lines(body, 64, mark) + mark + end.format(name)

    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + draw.randbytes(16).hex().upper() + "\n\n"
    headed = begin.format("RSA ") + "\n" + headers + lines(base64.b64encode(draw.randbytes(96)).decode(), 64) + "\n" + end.format("RSA ")
    for text in (block(cipher, "ENCRYPTED "), block(cipher, "ENCRYPTED ", "\\n"), headed, block(plain, "RSA ", "\n> "), block(plain, "", "\n>  ")):
        assert of(f"> see {text} there", "pem") == [("pem", text)]
    for text in (
        block(base64.b64encode(draw.randbytes(200)).decode(), "ENCRYPTED "),
        headed.replace("DEK-Info", "Dek"),
        begin.format("") + "\n" + headers + "short" + end.format(""),
    ):
        assert of(text, "pem") == []


def test_clean_hex_is_no_key():
    draw = random.Random(3)
    for _ in range(300):
        assert of("digest " + draw.randbytes(draw.choice([32, 64, 200])).hex(), "der") == []


MAGIC_START = base64.b64encode(secrets.MAGIC).decode()
WORST = {
    "magic": lambda n: MAGIC_START * (n // len(MAGIC_START)),
    "magic with lengths": lambda n: base64.b64encode((secrets.MAGIC + b"\0\0\0\4none" * 3 + b"\0\0\0\1") * (n // 80)).decode(),
    "starts of sequences": lambda n: "MIIJAgIBAAAAAAAA" * (n // 16),
    "nested sequences": lambda n: base64.b64encode(b"\x30\x82\x7f\xff\x02\x01\x00\x30\x82\x7f\x00" * (n // 15)).decode(),
    "starts in hex": lambda n: "3082ffff0201000500" * (n // 18),
    "blocks without an end": lambda n: "-----BEGIN PRIVATE KEY-----\nMIIB" * (n // 32),
    "quoted lines": lambda n: ("A" * 60 + "\n> ") * (n // 63),
    "assignments": lambda n: "token=" * (n // 6),
}


def cpu(run, text):
    start = time.process_time()
    run(text)
    return time.process_time() - start


@pytest.mark.parametrize("name", WORST)
def test_no_text_stops_the_secret_scan(name):
    times = [cpu(secrets.spans, WORST[name](n)) for n in (250_000, 500_000, 1_000_000)]
    assert times[-1] < 10 and times[-1] < 7 * times[0] + 0.5


def scan(text):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["_id", "_text"])
    return next(iter(licenses._scan(iter([batch])))).to_pylist()[0]


@pytest.mark.parametrize("unit", ["under the mit licence ", "gnu general public license", "redistribution and use in source ", "spdx license identifier "])
def test_no_text_stops_the_license_scan(unit):
    times = [cpu(scan, unit * (n // len(unit))) for n in (250_000, 500_000, 1_000_000)]
    assert times[-1] < 30 and times[-1] < 7 * times[0] + 0.5


def test_places_of_many_notices():
    found = scan("so under the mit licence ok " * 400)["notices"]
    assert [(f["first_word"], f["end_word"], f["edits"]) for f in found] == [(6 * i + 1, 6 * i + 5, 1) for i in range(400)]


@pytest.mark.parametrize("text", ["under the mit licenses12345", "xunder the mit license", "sunder the mit licensee x", "under the mitt license"])
def test_a_notice_ends_with_its_words(text):
    for label, a, b, _ in licenses.notices(text):
        assert (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " "), (label, text[a:b])


def test_misspelt_notices_are_found():
    """One edit for ten characters, outside of the words that tell the license; recall against the truth."""
    draw, caught, total = random.Random(4), 0, 0
    for notice, label in licenses.NOTICES:
        plain = notice.replace("{", "").replace("}", "")
        fixed = [i for i, c in enumerate(notice) if c == "{"], [i for i, c in enumerate(notice) if c == "}"]
        kept = range(fixed[0][0], fixed[1][0] - 1) if fixed[0] else range(0)
        free = [i for i, c in enumerate(plain) if i not in kept and i + 1 not in kept and i - 1 not in kept and c != " "]
        for _ in range(20):
            text = list(plain)
            for i in draw.sample(free, min(len(free), draw.randint(0, len(plain) // licenses.PER_EDIT))):
                text[i] = draw.choice("qxz")
            total += 1
            words = " ".join(["these", "words", "before", "".join(text), "and", "after"])
            caught += label in {found[0] for found in licenses.notices(words)}
    assert caught >= 0.95 * total


def test_spdx_lines_name_their_license():
    lines = {"GPL-3.0-only": "gpl", "LGPL-2.1": "lgpl", "AGPL-3.0": "agpl", "MIT": "mit", "Apache-2.0": "apache-2", "ISC": "isc", "CC0-1.0": "cc0", "EPL-2.0": "epl"}
    for name, label in lines.items():
        assert scan(f"# SPDX-License-Identifier: {name}\nimport this")["labels"] == label
