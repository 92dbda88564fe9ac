"""The pivot: chunks of arrays to rows."""
