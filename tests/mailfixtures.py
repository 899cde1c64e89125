"""Generated mailbox fixtures (neutral names; nothing copied from elsewhere).

The four-message list mailbox: folded headers, four time zones, three
multipart bodies, one plain body, quoted lines, Status: R, one reply inside
the mailbox, one message whose References name five absent ids.
"""

from __future__ import annotations

from pathlib import Path

BOUNDARY = "b1_part_boundary"


def _msg(envelope_from, envelope_date, headers: list[str], body: str) -> str:
    return f"From {envelope_from} {envelope_date}\n" + "\n".join(headers) + "\n\n" + body + "\n"


def _multipart(text: str) -> str:
    return (f"--{BOUNDARY}\nContent-Type: text/plain; charset=UTF-8\n"
            f"Content-Transfer-Encoding: 7bit\n\n{text}\n--{BOUNDARY}--\n")


def four_messages() -> list[str]:
    refs = " ".join(f"<ref{i}@old.example>" for i in range(1, 6))
    m1 = _msg("ann1@g.example", "Mon Nov  1 08:53:49 2010", [
        "Received: from mx.l.example (mx.l.example [192.0.2.1])",
        "\tby host.example with SMTP id abc",
        "From: Ann One <ann1@g.example>",
        "To: list@l.example",
        "Subject: Re: Indexing with key",
        "Date: Mon, 1 Nov 2010 08:53:49 +0000",
        "Message-ID: <m1@g.example>",
        f"In-Reply-To: <ref5@old.example>",
        f"References: {refs}",
        "Status: R",
        "MIME-Version: 1.0",
        f'Content-Type: multipart/alternative; boundary="{BOUNDARY}"',
    ], _multipart("> earlier text\nAnswer one."))
    m2 = _msg("bea2@g.example", "Mon Nov  1 17:32:21 2010", [
        "From: Bea Two <bea2@g.example>",
        "To: list user <list@l.example>",
        "Subject: filtering results?",
        "Date: Mon, 1 Nov 2010 18:32:21 +0100",
        "Message-ID: <m2@g.example>",
        "Status: R",
        "MIME-Version: 1.0",
        f'Content-Type: multipart/alternative; boundary="{BOUNDARY}"',
    ], _multipart("How do I filter?"))
    m3 = _msg("cy3@g.example", "Mon Nov  1 19:00:07 2010", [
        "From: Cy Three <cy3@g.example>",
        "To: list@l.example",
        "Subject: Re: filtering results?",
        "Date: Mon, 1 Nov 2010 15:00:07 -0400",
        "Message-ID: <m3@g.example>",
        "In-Reply-To: <m2@g.example>",
        "References: <m2@g.example>",
        "Status: R",
        "MIME-Version: 1.0",
        f'Content-Type: multipart/alternative; boundary="{BOUNDARY}"',
    ], _multipart("> How do I filter?\nUse a query."))
    m4 = _msg("di4@g.example", "Mon Nov  1 19:25:49 2010", [
        "From: Di Four <di4@g.example>",
        "To: list-group <list@l.example>",
        "Subject: Best way to update",
        " fields",
        "Date: Mon, 1 Nov 2010 17:25:49 -0200",
        "Message-ID: <m4@g.example>",
        "Status: R",
        "Content-Type: text/plain",
    ], "Plain body here.")
    return [m1, m2, m3, m4]


def write_four_message_mbox(path: Path, copies: int = 1) -> str:
    text = "".join(four_messages()) * copies
    path.write_text(text)
    return str(path)


def write_many(path: Path, n: int) -> str:
    """n small messages (for split-size invariance)."""
    out = []
    for i in range(n):
        out.append(_msg(f"u{i}@x.example", "Mon Nov  1 08:00:00 2010", [
            f"From: U{i} <u{i}@x.example>", "To: t@x.example", f"Subject: s{i % 7}",
            "Date: Mon, 1 Nov 2010 08:00:00 +0000", f"Message-ID: <n{i}@x.example>"],
            f"body {i}\nline two of {i}"))
    path.write_text("".join(out))
    return str(path)
