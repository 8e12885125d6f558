"""The archive reader on loaded, damaged and cut-off archives."""

import hashlib
import random

import pytest
import zstandard

from logfacts.llm import warc


def page(i, text):
    raw = text.encode()
    return warc.record("response", i, f"u{i}", raw, hashlib.sha1(raw).hexdigest(), len(raw), None), raw


WORDS = ["<div class='entry'>", "</div>", "alpha", "beta", "gamma", "<p>", "</p>", "delta "]
RND = random.Random(1)
PAGES = [page(i, " ".join(RND.choice(WORDS) for _ in range(200))) for i in range(60)]
DICTIONARY = zstandard.train_dictionary(4096, [raw for _, raw in PAGES]).as_bytes()


def archive(lead, dictionary=DICTIONARY):
    engine = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return warc.dictionary_frame(lead) + b"".join(engine.compress(made) for made, _ in PAGES[:5])


PACKED = zstandard.ZstdCompressor().compress(DICTIONARY)


@pytest.mark.parametrize("lead", [DICTIONARY, PACKED])
def test_a_dictionary_is_loaded_plain_or_compressed(lead):
    assert [block for _, block in warc.read_archive(archive(lead))] == [raw for _, raw in PAGES[:5]]


@pytest.mark.parametrize("lead", [PACKED[:-5], PACKED[:20], PACKED + PACKED, PACKED[:8] + b"\xff" * (len(PACKED) - 8), DICTIONARY[:4] + b"\xff" * 200, DICTIONARY[:40], b"other bytes", b""])
def test_a_damaged_or_wrong_dictionary_is_a_bad_archive(lead):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(archive(lead)))


@pytest.mark.parametrize("change", [(b"WARC-Target-URI: u0", b"WARC-Target-URI: \xff0"), (b"WARC-Payload-Length: ", b"WARC-Payload-Length: x"), (b"WARC-Payload-Length: ", b"WARC-Payload-Length: 9"), (b"Content-Length: ", "Content-Length: ٣".encode()), (b"WARC-Target-URI: u0", b"WARC-Target-URI u0"), (b"\r\n\r\n", b"\r\n")])
def test_bad_headers(change):
    bad = PAGES[0][0].replace(*change, 1)
    assert bad != PAGES[0][0]
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(warc.dictionary_frame(b"") + zstandard.ZstdCompressor().compress(bad)))


def test_cut_and_changed_bytes_raise_nothing_else():
    rnd = random.Random(2)
    for lead in (DICTIONARY, PACKED):
        whole = archive(lead)
        starts = len(warc.dictionary_frame(lead))
        for at in [*range(12), *(rnd.randrange(len(whole)) for _ in range(150))]:
            try:
                assert len(list(warc.read_archive(whole[:at]))) < 5  # cut between frames it is a shorter archive
            except warc.BadArchive:
                pass
        for _ in range(300):
            at = rnd.randrange(len(whole))
            changed = whole[:at] + bytes([whole[at] ^ (1 << rnd.randrange(8))]) + whole[at + 1 :]
            try:
                found = [block for _, block in warc.read_archive(changed)]
                assert at < starts or found == [raw for _, raw in PAGES[:5]] or all(hashlib.sha1(b).hexdigest() for b in found)
            except warc.BadArchive:
                pass
