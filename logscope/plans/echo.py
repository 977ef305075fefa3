"""A model client whose reply is a pure function of the prompt, for queries that must give one result anywhere."""

from __future__ import annotations

import hashlib


class Echo:
    """Replies with the prompt's md5 between spaces; refuses prompts whose md5 begins with 0; has no reply to
    those whose md5 begins with 1."""

    def complete(self, prompt: str, max_tokens: int) -> str | None:
        h = hashlib.md5(prompt.encode()).hexdigest()
        if h[0] == "0":
            raise RuntimeError("refused")
        return None if h[0] == "1" else f" {h} "


def reply_sql(prompt: str) -> str:
    """The same in SQL."""
    h = f"md5({prompt})"
    return f"CASE WHEN {prompt} IS NULL OR substr({h}, 1, 1) = '1' THEN NULL WHEN substr({h}, 1, 1) = '0' THEN 'Error: refused' ELSE ' ' || {h} || ' ' END"
