"""Training-data operators: licences, quality, duplicates, tokens, vectors, chat, packing, shards.

Nothing else in the library imports this subpackage.
"""
