"""quizmill: analytics for multiple-choice item pipelines, expressed with Spark DataFrames."""
