"""Batch operators.

Column names that operators expect:

* orders   - point_id, account, product_id, amount, paid_at, plus what each function names
* points   - point_id, site_id and any attributes (one row per point)
* sites    - site_id and any attributes (one row per site)
* terminal sales - terminal_id, amount, sold_at; terminals - terminal_id, channel_id, area_id

Facts are aggregated by their own id before a dimension is joined, so joins see one row per
id and never the raw orders of a hot point. No broadcast hint is used: Spark broadcasts a
side only when it knows the size to be below its threshold and otherwise shuffles.
"""
