"""From query text to a DataFrame: parser, algebra and its compilation."""
