"""Chat examples: the text and the marked answer in a message list, and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of the default model, in tokens and characters.
CONTEXT_TOKENS, CHARS_PER_TOKEN, OVERHEAD_TOKENS, PROMPT_MARGIN = 4096, 2, 256, 64
# The extraction doesn't draw.
TEMPERATURE, SEED = 0.0, 42


def of_role(messages: Column, role: str) -> Column:
    """Content of the first message of a role that has content; null for none."""
    found = F.filter(messages, lambda m: (m["role"] == role) & m["content"].isNotNull())
    return F.try_element_at(found, F.lit(1))["content"]


def after_first_line(content: Column) -> Column:
    """What follows the first line end; empty without one, null for null."""
    at = F.position(F.lit("\n"), content)
    return F.when(at > 0, F.substr(content, at + 1)).when(content.isNotNull(), F.lit(""))


def prompt(system: str, doc: Column, text: Column) -> Column:
    """The two messages that ask a model to mark a window."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("documento_id: "), doc, F.lit("\n\n"), text)))


def reserved_tokens(system: str) -> int:
    return (len(system) + PROMPT_MARGIN) // CHARS_PER_TOKEN + OVERHEAD_TOKENS


def answer_tokens(system: str, context: int = CONTEXT_TOKENS) -> int:
    free = max(0, context - reserved_tokens(system))
    return max(64, min(context // 2, free * 3 // 5))


def sampling(system: str, context: int = CONTEXT_TOKENS) -> dict[str, float | int]:
    """What a model is to sample an answer with."""
    return {"temperature": TEMPERATURE, "seed": SEED, "max_tokens": answer_tokens(system, context)}


def text_budget(system: str, overlap: int = 200, context: int = CONTEXT_TOKENS) -> int:
    """Characters of text that a window may have beside the prompt and the answer."""
    return max(overlap, context - answer_tokens(system, context) - reserved_tokens(system)) * CHARS_PER_TOKEN
