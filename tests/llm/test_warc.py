from rippleframe.llm.warc import derive, digest, parse, record, response


def _about(derived):
    return parse(derived[3])[0][1].decode().split("\r\n")


def test_metadata_keeps_every_source_header():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n  two\r\n\r\n<p>gone"
    source = record(
        [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Date", "2020-02-02T00:00:00Z"), ("WARC-Target-URI", "http://x/"),
         ("WARC-Block-Digest", digest(block)), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Concurrent-To", "<urn:x:2>"), ("WARC-Concurrent-To", "<urn:x:3>")],
        block,
    )
    about = _about(derive(source)[0])
    assert "source-http: HTTP/1.1 404 Not Found" in about
    for line in ("Content-Type: text/html", "Set-Cookie: a=1", "Set-Cookie: b=2", "X-Long: one two"):
        assert f"source-http-header: {line}" in about
    for line in (f"WARC-Block-Digest: {digest(block)}", "WARC-IP-Address: 192.0.2.1", "WARC-Concurrent-To: <urn:x:2>", "WARC-Concurrent-To: <urn:x:3>"):
        assert f"source-warc-header: {line}" in about


def test_every_response_is_derived_and_nothing_else():
    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x:0>"), ("WARC-Date", "2020-02-02T00:00:00Z")], b"software: x\r\n")
    one, two = response("http://x/1", "<p>one"), response("http://x/2", "<p>two")
    out = derive(info + one + two)
    assert [d[0] for d in out] == ["metadata", "conversion"] * 2
    assert [parse(d[3])[0][1] for d in out if d[0] == "conversion"] == [b"one", b"two"]
    assert [d[2] for d in out[::2]] == [parse(x)[0][0]["WARC-Record-ID"] for x in (one, two)]


def test_equal_pages_of_other_sources_have_ids_of_their_own():
    head = [("WARC-Type", "response"), ("WARC-Date", "2020-02-02T00:00:00Z"), ("WARC-Target-URI", "http://x/")]
    block = b"HTTP/1.1 200 OK\r\n\r\n<p>same"
    out = derive(b"".join(record([*head, ("WARC-Record-ID", f"<urn:x:{k}>")], block) for k in range(2)))
    assert len({d[1] for d in out}) == 4
