"""Structured Streaming jobs.

Windows are on event time. State is what Spark keeps for a streaming aggregate; results
leave in update mode as one small folder per micro-batch, so a batch neither rewrites nor
rereads earlier output, and a replayed batch replaces itself.
"""
