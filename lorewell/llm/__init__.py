"""Training-data operators: deduplication, decontamination, scans, mixing, sharding.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` collect what
its modules register.
"""
