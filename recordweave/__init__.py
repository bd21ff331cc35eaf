"""recordweave: Spark jobs over landed public-records payloads.

Parse payload tables, resolve mentions to entities, score and de-duplicate
candidates, check cited claims, build time-decayed entity graphs, and report on
quality and pipeline health. Everything is a DataFrame -> DataFrame function.
"""
