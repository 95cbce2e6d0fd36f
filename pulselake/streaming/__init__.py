"""pulselake.streaming"""
