"""Log analytics for an API gateway as plain DataFrame -> DataFrame functions."""
