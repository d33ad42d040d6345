"""Steps from articles to themes: DataFrame in, DataFrame out."""
