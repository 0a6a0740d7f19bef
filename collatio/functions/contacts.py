"""What a line says about a contact, for operators that work on one document pair at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

from .aligned import plain
from .lexicon import CONTACT_LABELS, DEFAULT, EMAIL, PHONE, Lexicon
from .scalar import key_of

HEADED = re.compile(r"(?i)\s*(?P<label>(?:INVESTOR|EDITORIAL)\s+CONTACT:?)\s*")
LABEL = re.compile("(?P<label>" + "|".join(map(re.escape, CONTACT_LABELS)) + ")(?:[: ].*)?", re.S)


@dataclass(frozen=True)
class Contact:
    """A line's label, the fields in it, and what it is itself."""

    said: str
    lexicon: Lexicon

    @cached_property
    def patterns(self) -> dict[str, str]:
        return {"contact_company": self.lexicon.company_pattern, "contact_email": EMAIL, "contact_phone": PHONE}

    @cached_property
    def label(self) -> str | None:
        found = LABEL.fullmatch(key_of(self.said))
        return found and CONTACT_LABELS[found["label"]]

    @cached_property
    def few_words(self) -> bool:
        return self.said[:1].isupper() and len(self.said.split()) <= 4

    @cached_property
    def parts(self) -> dict[str, str]:
        """Every field; the name is what stands before the first other one."""
        headed = HEADED.match(self.said)
        body = self.said[headed.end() :].strip() if headed else self.said
        met = {role: m for role, p in self.patterns.items() if (m := re.search(p, body))}
        fields = {role: m.group().strip() for role, m in met.items()}
        fields["contact_label"] = headed["label"].strip() if headed else ""
        fields["contact_name"] = body[: min((m.start() for m in met.values()), default=len(body))].strip(" ,;")
        return {role: value for role, value in fields.items() if value}

    @cached_property
    def value(self) -> tuple[str, str] | None:
        """The one field that the line is: its label, else the first pattern it has, else a short name."""
        if self.label:
            return "contact_label", self.parts.get("contact_label", self.said)
        met = ((role, re.search(p, self.said)) for role, p in self.patterns.items())
        named = ("contact_name", self.said) if self.few_words and not self.said.isupper() else None
        return next(((role, m.group().strip()) for role, m in met if m), named)

    @cached_property
    def like(self) -> bool:
        """Whether the line reads like one of a contact's."""
        company = key_of(self.said) == f"{self.lexicon.company.lower()}, inc."
        return bool(self.said) and bool(self.label or self.few_words or company or re.search(EMAIL, self.said) or re.search(PHONE, self.said))


@lru_cache(maxsize=20_000)
def contact(text: str | None, lexicon: Lexicon = DEFAULT) -> Contact:
    return Contact(plain(text).strip(), lexicon)
