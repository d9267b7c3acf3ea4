"""Training-data operators: tokenisation, cleaning, classification, scanning and deduplication of documents."""
