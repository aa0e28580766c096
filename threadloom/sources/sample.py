"""A small corpus with the traps that a pipeline of news texts must stand, written from rules."""

from __future__ import annotations

import json
from pathlib import Path

PEOPLE = (("Ana", "Moro", "Prime Minister", "Kelvar Group"), ("Luis", "Tarnek", "President", "Zondin Bank"), ("Berta", "Tarnek", "Foreign Minister", "Velmora Council"))


def records() -> list[dict]:
    """Articles: aliases and pronouns, markup and entities, invisible signs, two persons of one surname, a repeated
    address, a stub, a missing date; why says which."""
    (a, b, role, org), (c, d, role2, org2), (e, f, role3, org3) = PEOPLE
    body = f"{role} {a} {b} met {role2} {c} {d} in Velmora. {b} discussed climate change with {d}. She said the talks at {org} would go on."
    out = [
        ("names and pronouns", "Talks in Velmora", body * 2, "https://news.example/1", "2024-10-22T10:00:00+05:30"),
        ("markup and entities", "Markup", f"<p>{body}</p><script>var x = '<p>';</script><ul><li>R&amp;D&nbsp;at {org2}</li></ul>", "https://news.example/2", "2024-10-23T08:00:00+03:00"),
        ("invisible and typographic signs", "Signs", body.replace(" ", "\u00a0", 3).replace("met", "\u200bmet") + " \u201cYes\u201d \u2014 no\u2026", "https://news.example/3", "2024-10-24T08:00:00+08:00"),
        ("another person of the same surname", "Surname", f"{role3} {e} {f} spoke for {org3}. {f} did not meet {a} {b}. The Foreign Minister left early after the 3rd Trade Summit." * 2, "https://news.example/4", "2019-01-05T00:00:00Z"),
        ("the address of an earlier article", "Talks in Velmora", body * 2, "https://news.example/1", "2024-10-22T10:00:00+05:30"),
        ("too short", "Stub", "Nothing more.", "https://news.example/5", "2024-10-25T00:00:00Z"),
        ("no date", "Undated", body, "https://news.example/6", None),
    ]
    return [{"title": t, "source": "News Example", "published_at": w, "url": u, "body": x, "extra": {"section": "world"}, "why": y} for y, t, x, u, w in out]


def write(path: str | Path) -> int:
    """One JSON object a line, without why, then a broken line; the number of lines written."""
    lines = [json.dumps({k: v for k, v in r.items() if k != "why"}, ensure_ascii=False) for r in records()] + ['{"title": "broken", ']
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return len(lines)
