"""Training-data operators: language ID, line dedup, mixing, quality, WARC, SimHash, URL trust, toxicity, decontamination, chat.

The subpackage stands alone: nothing else in the library imports it, and it imports nothing else of the library.
"""
