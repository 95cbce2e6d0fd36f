"""pulselake.sources"""
