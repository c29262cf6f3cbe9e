"""Rule expressions and rule sets as Spark columns."""
