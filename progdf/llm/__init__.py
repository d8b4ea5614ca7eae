"""Training-data operators: dedup, quality, language, search, clusters, media, HTML, periodic runs, BPE, token counts, mixing, licences."""
