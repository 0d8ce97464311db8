"""All queries of the package: importing this module registers them."""

from millrace.llm import (  # noqa: F401
    embeddings,
    exact_search,
    lexical_search,
    licenses,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    toxicity,
    warc,
    whitening,
)
from millrace.llm.common import ORACLES, QUERIES  # noqa: F401
