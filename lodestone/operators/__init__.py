"""Search, matching, reading, index maintenance and edits over DataFrames."""
