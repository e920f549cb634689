"""Model, vendor and path names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"

# The vendor written before a slash in a model id.
SLASH_VENDORS = [
    (["openai", "~openai"], "OpenAI"),
    (["anthropic"], "Anthropic"),
    (["google"], "Google"),
    (["meta", "meta-llama"], "Meta"),
    (["mistralai", "mistral"], "Mistral"),
    (["deepseek"], "DeepSeek"),
    (["qwen", "alibaba"], "Qwen"),
    (["x-ai", "xai"], "xAI"),
    (["nvidia"], "NVIDIA"),
    (["cohere"], "Cohere"),
    (["amazon", "bedrock"], "Amazon"),
    (["microsoft"], "Microsoft"),
    (["upstage"], "Upstage"),
    (["cerebras"], "Cerebras"),
    (["groq"], "Groq"),
    (["together"], "Together"),
    (["perplexity"], "Perplexity"),
]

# The vendor written before a colon in a display label.
COLON_VENDORS = [
    (["openai"], "OpenAI"),
    (["anthropic"], "Anthropic"),
    (["google"], "Google"),
    (["meta"], "Meta"),
    (["mistral", "mistralai"], "Mistral"),
    (["deepseek"], "DeepSeek"),
    (["qwen", "alibaba"], "Qwen"),
    (["xai", "x-ai"], "xAI"),
    (["nvidia"], "NVIDIA"),
    (["cohere"], "Cohere"),
]

# Model families, tried in order. A word ending in '*' must start
# the name; any other word may be anywhere in it.
FAMILY_VENDORS = [
    (["claude"], "Anthropic"),
    (["gemini", "gemma", "antigravity"], "Google"),
    (["gpt-*", "chatgpt*", "o1-*", "o3-*", "o4-*", "openai", "dall-e*", "text-embedding*"], "OpenAI"),
    (["deepseek"], "DeepSeek"),
    (["qwen"], "Qwen"),
    (["llama", "muse"], "Meta"),
    (["mistral", "mixtral", "codestral", "ministral", "pixtral"], "Mistral"),
    (["nemotron"], "NVIDIA"),
    (["grok"], "xAI"),
    (["command"], "Cohere"),
    (["phi-", "phi*"], "Microsoft"),
    (["titan-", "titan*"], "Amazon"),
]

OTHER = "Other"


def normalize_model(model: Column) -> Column:
    """Vendor- and format-agnostic key: bare name, lower case, no release date, '.' as '-'."""
    bare = F.lower(F.substring_index(model, "/", -1))
    # Most ids carry no date, and a substring test is far cheaper than the pattern.
    dated = F.contains(bare, F.lit("-20"))
    undated = F.when(dated, F.regexp_replace(bare, r"-20[0-9]{6}\z", "")).otherwise(bare)
    return F.replace(undated, F.lit("."), F.lit("-"))


def hyphenate_label(label: Column) -> Column:
    """Matchable form of a display label: drops a parenthesised tier, blanks become '-'."""
    # An unclosed bracket swallows the rest; a stray closing one just vanishes.
    kept = F.regexp_replace(label, r"\([^)]*(\)|\z)", "")
    kept = F.translate(kept, ")", "")
    return F.btrim(F.lower(F.translate(kept, " \t_", "---")), F.lit("-"))


def _family_test(name: Column, words: list[str]) -> Column:
    test = None
    for word in words:
        hit = F.startswith(name, F.lit(word[:-1])) if word.endswith("*") else F.contains(name, F.lit(word))
        test = hit if test is None else test | hit
    return test


def provider_of_model(model: Column) -> Column:
    """Vendor of a model id, as one CASE chain over the fixed rule lists."""
    name = F.lower(F.btrim(model, F.lit(BLANKS)))
    before_slash = F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", 1))
    before_colon = F.when(
        F.contains(name, F.lit(":")),
        F.btrim(F.substring_index(name, ":", 1), F.lit(BLANKS)),
    )
    chain = F.when(name == "", OTHER)
    for words, vendor in SLASH_VENDORS:
        chain = chain.when(before_slash.isin(words), vendor)
    for words, vendor in COLON_VENDORS:
        chain = chain.when(before_colon.isin(words), vendor)
    for words, vendor in FAMILY_VENDORS:
        chain = chain.when(_family_test(name, words), vendor)
    return chain.otherwise(OTHER)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*\z", 1), r"\.[^.]*\z", "")


def path_leaf(path: Column) -> Column:
    """Last component of a path written with either slash; 'unknown' when there is none."""
    text = F.regexp_replace(F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(path), r"[\\/]+\z", "")
    leaf = F.regexp_extract(text, r"([^\\/]*)\z", 1)
    return F.when(leaf != "", leaf).when(text != "", text).otherwise("unknown")


def path_hash_id(agent: Column, path: Column) -> Column:
    """Stable session id for a log that carries none."""
    return F.concat(agent, F.lit(":"), F.substring(F.sha2(path, 256), 1, 32))
