"""All queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from terrane.llm import fingerprints, jaccard_join, language_id, license_scan, media, mixing, oracles, sentence_pieces, sharding, suffix_dedup, token_counts

QUERIES = {}
for _module in (language_id, mixing, sentence_pieces, fingerprints, suffix_dedup, media, sharding, jaccard_join, license_scan, token_counts):
    QUERIES |= _module.QUERIES
SQL: dict[str, str] = dict(oracles.SQL)
