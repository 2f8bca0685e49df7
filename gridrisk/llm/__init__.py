"""Corpus operators for large text collections: language ID, token storage, near-duplicate
joins, line dedup, fingerprints, byte-level BPE, licence scans, chat formatting, benchmark
decontamination, link-graph URL filters, secret scans, fill-in-middle and Merkle manifests.

Nothing outside this folder imports it; it uses the library's session helpers only.
"""
