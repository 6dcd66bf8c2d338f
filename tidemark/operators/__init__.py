"""Operators on change logs, change sets, manifests, ledgers and schemas: DataFrames in and out."""
